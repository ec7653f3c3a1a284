"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The model is of the BPE kind. A segmentation is BPE's own exactly if every two neighbours are what BPE makes of their
concatenation. So encoding is a best-path problem over the max-plus semiring with weight 0 for such neighbours and minus
infinity for others. A giant document is cut into chunks anywhere. The state at a cut is the piece that begins before it
and reaches up to it or over it. Each chunk yields a transfer matrix between the states at its two ends; matrices are
combined associatively, in a tree of bounded fan-in; the state at every cut follows from the root downwards, and each chunk
is then traced back by itself. Only entries of weight 0 are kept.

No piece of the model goes on over a word's end into a blank; so between the first and the last word's end of a chunk,
pieces are found word by word, and only the ends of a chunk are searched. Shorter documents are encoded word by word.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, need, stage

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: A document of more characters is giant; characters of its chunks; matrices combined at a time.
GIANT, CHUNK, FAN_IN = 65_536, 16_384, 64
BLANK = "▁"
_UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+$")
_CUT = re.compile(f"(?<=[^{BLANK}]){BLANK}")
Matrix = list[tuple[int, int]]


class Pieces:
    """A model in one task: pieces, scores and what is remembered of words and pairs."""

    LIMIT = 400_000

    def __init__(self, proto: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.scores = {p: self.sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if self.sp.is_byte(i)}
        self.texts = [p.replace(BLANK, " ").encode() if plain[i] else bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else b"" for i, p in enumerate(pieces)]
        #: No piece is longer.
        self.reach = max(map(len, self.ids), default=1)
        self.units: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}

    def of_unit(self, unit: str) -> bytes:
        """Ids (int32) of blanks and the word after them."""
        found = self.units.get(unit)
        if found is None:
            if len(self.units) >= self.LIMIT:
                self.units.clear()
            found = np.array(self.sp.encode(unit[1:].replace(BLANK, " ")), np.int32).tobytes()  # the model puts a blank in front
            if len(unit) <= 64:
                self.units[unit] = found
        return found

    def of_units(self, text: str) -> bytes:
        return b"".join(map(self.of_unit, _UNIT.findall(text)))

    def encode(self, text: str) -> bytes:
        return self.of_units(marked(text)) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]

    def of_piece(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode()]

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored neighbours are merged, the leftmost of equals first."""
        symbols: list[str | None] = list(text)
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                both = symbols[i] + symbols[after[i]]
                if both in self.scores:
                    heapq.heappush(heap, (-self.scores[both], i, both))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if symbols[i] is None or after[i] < 0 or symbols[i] + symbols[after[i]] != both:
                continue
            j = after[i]
            symbols[i], symbols[j], after[i] = both, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s is not None]

    def is_piece(self, piece: str) -> bool:
        if piece not in self.alone:
            if len(self.alone) >= self.LIMIT:
                self.alone.clear()
            self.alone[piece] = (piece in self.ids or len(piece) == 1) and self.merged(piece) == [piece]
        return self.alone[piece]

    def neighbours(self, a: str, b: str) -> bool:
        if not a:
            return True
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) >= self.LIMIT:
                self.pairs.clear()
            self.pairs[key] = self.merged(a + b) == [a, b]
        return self.pairs[key]

    def paths(self, text: str, begin: int, end: int, entries: dict[int, str]) -> dict[tuple[int, int], dict]:
        """From entries (position to go on at -> the piece before it, as (state, piece, position)), all pieces that begin before end.

        The result maps (start, stop) of each reached piece to {entry state: the piece before}.
        """
        reached: dict[tuple[int, int], dict] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        fresh: dict[int, list[tuple[int, str]]] = {}
        for state, (piece, at) in entries.items():
            fresh.setdefault(at, []).append((state, piece))
        for i in range(begin, end):
            before = [(key, text[key[0] : key[1]], reached[key]) for key in ends.get(i, [])]
            if not before and i not in fresh:
                continue
            for j in range(i + 1, min(len(text), i + self.reach) + 1):
                piece = text[i:j]
                if not self.is_piece(piece):
                    continue
                got: dict = {}
                for state, prior in fresh.get(i, []):
                    if self.neighbours(prior, piece):
                        got[state] = None
                for key, prior, states in before:
                    if self.neighbours(prior, piece):
                        for s in states:
                            got.setdefault(s, key)
                if got:
                    reached[i, j] = got
                    ends.setdefault(j, []).append((i, j))
        return reached


def marked(text: str) -> str:
    """A text as the model sees it: a blank in front, and blanks as the blank mark."""
    return BLANK + text.replace(" ", BLANK)


def _state(s: int, e: int) -> int:
    """Of a piece that begins s characters before a cut and ends e after it."""
    return s * 65_536 + e


class Chunk:
    """A chunk [begin, end) of a text that also holds the longest piece's characters on either side, as far as there are such."""

    def __init__(self, pieces: Pieces, text: str, begin: int, end: int):
        self.p, self.text, self.begin, self.end = pieces, text, begin, end
        cuts = [m.start() for m in _CUT.finditer(text, begin + pieces.reach, end - pieces.reach)]
        #: Where the first and the last word end; the search is for the characters before and after.
        self.first, self.last = (cuts[0], cuts[-1]) if cuts else (None, None)

    def entries(self) -> dict[int, tuple[str, int]]:
        """State at the begin -> the piece that begins before it, and where that piece ends."""
        if self.begin == 0:
            return {0: ("", 0)}
        found = {}
        for s in range(1, min(self.p.reach, self.begin) + 1):
            for e in range(self.p.reach - s + 1):
                a, b = self.begin - s, self.begin + e
                if b <= len(self.text) and self.p.is_piece(self.text[a:b]):
                    found[_state(s, e)] = (self.text[a:b], b)
        return found

    def head(self) -> tuple[dict, dict[int, tuple[int, int]]]:
        """Pieces reached before the first word's end, and the last of them by the entry state it is reached from."""
        reached = self.p.paths(self.text, self.begin, self.first, self.entries())
        return reached, {s: key for key, states in reached.items() if key[1] == self.first for s in states}

    def tail(self) -> tuple[dict, dict[int, tuple[int, int]]]:
        """Pieces reached after the last word's end, or from the entries where no word ends; the last by the state at the end."""
        reached = self.p.paths(self.text, self.begin, self.end, self.entries()) if self.last is None else self.p.paths(self.text, self.last, self.end, {0: ("", self.last)})
        final = self.end == len(self.text)
        return reached, {_state(self.end - i, j - self.end): (i, j) for i, j in reached if (j == self.end if final else j >= self.end)}

    def matrix(self) -> Matrix:
        reached, exits = self.tail()
        if self.last is None:
            return sorted((s, x) for x, key in exits.items() for s in reached[key])
        return [(s, x) for s in sorted(self.head()[1]) for x in sorted(exits)]

    def trace(self, entry: int, leave: int) -> bytes:
        """Ids of the pieces that begin in the chunk, for the states at its two ends."""

        def back(reached: dict, key: tuple[int, int] | None, state: int) -> list[int]:
            found = []
            while key is not None:
                found.append(self.p.of_piece(self.text[key[0] : key[1]]))
                key = reached[key][state]
            return [i for ids in reversed(found) for i in ids]

        reached, exits = self.tail()
        if self.last is None:
            return np.array(back(reached, exits[leave], entry), np.int32).tobytes()
        before, ends = self.head()
        return np.array(back(before, ends[entry], entry), np.int32).tobytes() + self.p.of_units(self.text[self.first : self.last]) + np.array(back(reached, exits[leave], 0), np.int32).tobytes()


def chunks(text: str, size: int, reach: int) -> Iterator[tuple[int, str, int, int]]:
    """(number, text with surroundings, begin, end) of each chunk of a marked text; the last has size to 2 * size characters."""
    n = max(1, len(text) // size)
    for k in range(n):
        begin, end = k * size, len(text) if k == n - 1 else (k + 1) * size
        yield k, text[max(0, begin - reach) : end + reach], begin - max(0, begin - reach), end - max(0, begin - reach)


def compose(matrices: list[Matrix]) -> Matrix:
    """The max-plus product, of weights 0 only."""
    total = matrices[0]
    for m in matrices[1:]:
        by: dict[int, list[int]] = {}
        for i, o in m:
            by.setdefault(i, []).append(o)
        total = sorted({(i, x) for i, o in total for x in by.get(o, ())})
    return total


def resolve(matrices: list[Matrix], entry: int, leave: int) -> list[tuple[int, int]]:
    """The states at both ends of each of some consecutive chunks, from those at the ends of all."""
    forward = [{entry: None}]
    for m in matrices:
        forward.append({o: i for i, o in m if i in forward[-1]})
    out, state = [], leave
    for level in reversed(forward[1:]):
        out.append((level[state], state))
        state = level[state]
    return out[::-1]


_loaded: dict[bytes, Pieces] = {}


def _pieces(proto: bytes) -> Pieces:
    key = hashlib.sha256(proto).digest()
    if key not in _loaded:
        _loaded[key] = Pieces(proto)
    return _loaded[key]


def model(path: str = MODEL_PATH) -> bytes:
    """The model file, half a megabyte; it goes to the tasks with the code."""
    with open(path, "rb") as f:
        return f.read()


def _flat(m: Matrix) -> list[int]:
    return [x for pair in m for x in pair]


def _pairs(flat) -> Matrix:
    flat = [int(x) for x in flat]
    return list(zip(flat[::2], flat[1::2], strict=True))


def encode_giants(giants: DataFrame, proto: bytes, chunk: int = CHUNK) -> DataFrame:
    """(blob, text) -> (blob, ids): each text by a parallel scan over its chunks."""
    spark: SparkSession = giants.sparkSession
    shared, reach = spark.sparkContext.broadcast(proto), _pieces(proto).reach

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k, part, begin, end = zip(*chunks(marked(text), chunk, reach), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([blob] * len(k)), pa.array(k, pa.int64()), pa.array(part), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["blob", "k", "part", "begin", "end"])

    def matrices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared.value)
        out = [_flat(Chunk(p, *x).matrix()) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["blob", "k", "m"])

    parts = stage(map_batches(giants.select("blob", "text"), cut, "blob string, k long, part string, begin int, end int"), "chunks")
    levels = [stage(map_batches(parts.repartition("blob", "k"), matrices, "blob string, k long, m array<int>"), "matrices")]
    keys = lambda df: df.withColumn("g", F.expr(f"k div {FAN_IN}"))

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"blob": pdf["blob"][:1], "k": pdf["g"][:1], "m": [_flat(compose([_pairs(m) for m in pdf["m"]]))]})

    while (levels[-1].agg(F.max("k")).first()[0] or 0) > 0:
        levels.append(stage(keys(levels[-1]).groupBy("blob", "g").applyInPandas(up, "blob string, k long, m array<int>"), "matrices"))

    def root(pdf_m: F.Column) -> F.Column:  # of the only path from the start to the end
        return F.element_at(pdf_m, 2)

    ends = levels[-1].select("blob", "k", F.lit(0).alias("entry"), root(F.col("m")).alias("leave"))

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        pairs = resolve([_pairs(m) for m in pdf["m"]], int(pdf["entry"].iloc[0]), int(pdf["leave"].iloc[0]))
        return pd.DataFrame({"blob": pdf["blob"], "k": pdf["k"], "entry": [i for i, _ in pairs], "leave": [o for _, o in pairs]})

    for level in reversed(levels[:-1]):
        of_group = ends.withColumnRenamed("k", "g")
        ends = stage(keys(level).join(of_group, ["blob", "g"]).groupBy("blob", "g").applyInPandas(down, "blob string, k long, entry int, leave int"), "states")

    def trace(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared.value)
        part, begin, end, entry, leave = (batch.column(i).to_pylist() for i in range(2, 7))
        out = [np.frombuffer(Chunk(p, t, b, e).trace(i, o), np.int32) for t, b, e, i, o in zip(part, begin, end, entry, leave, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["blob", "k", "ids"])

    traced = map_batches(parts.join(ends, ["blob", "k"]).select("blob", "k", "part", "begin", "end", "entry", "leave"), trace, "blob string, k long, ids array<int>")
    return traced.groupBy("blob").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, proto: bytes | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """The rows of docs with their columns and ids array<int>; an existing column ids is replaced.

    The ids are those of the model's own library. A null or empty text has no ids. Repeated rows are encoded each, but a
    giant text once for all its rows. An empty table gives an empty result.
    """
    proto = proto or model()
    shared = docs.sparkSession.sparkContext.broadcast(proto)
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared.value)
        raw = [p.encode(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    large = F.coalesce(F.length("text"), F.lit(0)) > giant
    plain = map_batches(docs.filter(~large), run, schema)
    giants = docs.filter(large)
    blobs = stage(giants.select(F.sha2("text", 256).alias("blob"), "text").groupBy("blob").agg(F.any_value("text").alias("text")), "giants")
    encoded = encode_giants(blobs, proto, chunk).withColumnsRenamed({"blob": "__blob", "ids": "__ids"})
    joined = giants.join(encoded, F.sha2(giants["text"], 256) == F.col("__blob"), "left").select(*(giants[c] for c in giants.columns), F.col("__ids").alias("ids"))
    return plain.unionByName(joined)


def round_trip(docs: DataFrame, proto: bytes | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as little-endian 32-bit integers), restored for each row of docs.

    restored: decoding gives the text again. It does for every text without U+2581, which the model takes for a blank.
    """
    shared = docs.sparkSession.sparkContext.broadcast(proto or model())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared.value)
        counts, digests, same = [], [], []
        column = batch.column(2)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        stops = np.cumsum([n or 0 for n in pa.compute.list_value_length(column).to_pylist()])
        for text, begin, end in zip(batch.column(1).to_pylist(), [0, *stops[:-1]], stops, strict=True):
            ids = values[begin:end]
            counts.append(len(ids))
            digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
            same.append(p.decode(ids) == (text or ""))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_sha256", "restored"])

    encoded = encode(need(docs, "doc_id", "text"), proto, giant, chunk)
    return map_batches(encoded, run, "doc_id long, n_ids long, ids_sha256 string, restored boolean")
