"""Language identification, periodic runs and spelling variants against brute force, SQL and held-out labels."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from blockweave.llm import language_id, periodic_runs, registry, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, start long, score double"
ODD = [(None, "no id here at all, no id here"), (5000, None), (5001, ""), (5002, " \n\t\x0b "), (5003, "123 ... 456"), (5004, "Ünïcödé wörds ÀÉ \U0001f600"), (5005, "same row"), (5005, "same row")]


def documents(spark, rows):
    """Documents with columns whose names clash with the operators' own. rows: (doc_id, text[, lang])."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1, "x", 7, 8, 0.5) for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op12_periodic_runs", "op13_spelling_variants"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name]).fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*(d[0] for d in con.description)).collect()))) == sorted(map(repr, want)) and want


# Languages


def ngrams(text):
    words = [f" {w} " for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
    return [w[k : k + n] for w in words for n in range(1, 5) for k in range(len(w) + 1 - n) if w[k : k + n].strip()]


def test_ngrams_are_those_of_words():
    texts = ["Ab c", None, "", "x" * 700_000 + " Éa1b", "Ab c"]
    found = collections.defaultdict(list)
    for text, bucket in language_id.grams(texts):
        for t, b in zip(text.tolist(), bucket.tolist(), strict=True):
            found[t].append(b)
    for t, text in enumerate(texts):
        assert len(found[t]) == len(ngrams(text or ""))
    assert sorted(found[0]) == sorted(found[4])
    alone = [b for _, bucket in language_id.grams(["c"]) for b in bucket.tolist()]
    assert set(alone) <= set(found[0])


def test_languages_against_counts_in_plain_python(spark):
    random.seed(3)
    letters = {"aa": "abcdeé", "bb": "abcdfg", "cc": "cdghiж"}
    rows = [(i, " ".join("".join(random.choices(letters[lang], k=random.randint(1, 7))) for _ in range(random.randint(1, 40))), lang) for i, lang in enumerate(random.choices(sorted(letters), [5, 3, 2], k=300))]
    rows += [(i, t, "aa") for i, t in ODD] + [(6000, "abc abc", None)]
    table = {(r["doc_id"], r["text"]): r for r in map(lambda r: r.asDict(), language_id.identify(documents(spark, rows)).join(documents(spark, rows).select("doc_id", "text").distinct(), "doc_id").collect())}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows if i is not None}
    seen, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t, lang in rows:
        if i is not None and t is not None and lang is not None and not held[i]:
            seen[lang].update(ngrams(t))
            texts[lang] += 1
    size = 1 << language_id.BITS
    for i, t, _ in rows:
        if i is None or t is None or not any(c.isalpha() for c in t):
            continue
        score = {}
        for lang, c in seen.items():  # hardly any of so few n-grams share a bucket
            total = sum(c.values()) + 0.5 * size
            score[lang] = math.log(texts[lang] / sum(texts.values())) + sum(math.log((c[g] + 0.5) / total) for g in ngrams(t))
        best = max(score.values())
        near = {lang for lang, s in score.items() if s > best - 0.02 * max(1, len(ngrams(t)) ** 0.5)}
        row = table[i, t]
        assert row["lang_pred"] in near and row["held_out"] == held[i] and 1 / 3 <= row["score"] <= 1
        if len(near) == 1:
            tempered = 1 / sum(math.exp((s - best) / math.sqrt(len(ngrams(t)))) for s in score.values())
            assert row["score"] == pytest.approx(tempered, abs=0.02)


def test_languages_of_odd_rows_and_empty_tables(spark):
    docs = documents(spark, ODD)
    got = [tuple(r) for r in language_id.identify(docs).collect()]
    assert len(got) == len(ODD)
    by = {r[0]: r[1:] for r in got}
    assert by[None] == (False, "en", 1.0) and all(by[i][1:] == ("und", 0.0) for i in (5000, 5001, 5002, 5003)) and by[5004][1] == "en"
    assert language_id.identify(docs.limit(0)).count() == 0
    nothing = {tuple(r)[2:] for r in language_id.identify(docs, docs.limit(0)).collect()}
    assert nothing == {("und", 0.0)}
    tie = documents(spark, [(k, "abc", lang) for lang in ("yy", "xx") for k in (3, 4, 5, 9)])
    assert {r["lang_pred"] for r in language_id.identify(tie).collect()} == {"xx"}


def test_the_same_in_any_partitioning_and_more_languages_in_less_space(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    one, many = language_id.train(docs.coalesce(1)), language_id.train(docs.repartition(7))
    assert one == many
    key = lambda m: sorted(tuple(r) for r in language_id.predict(docs, m).collect())
    assert key(one) == sorted(tuple(r) for r in language_id.predict(docs.repartition(5), one).collect())
    monkeypatch.setattr(language_id, "CELLS", 1 << 14)
    assert language_id.train(docs).bits == 12


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("want"))
    held = registry.op11_language_id(spark, SF).filter("held_out").join(docs, "doc_id").collect()
    assert held and sum(r["want"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


# Periodic runs


def plain_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            stretch = w[a : i + q]
            if i - a + q >= max(least, times * q) and not any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                out.append((a, i - a + q, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    """Words with runs, runs of runs, broken runs, and periods in which every short gram recurs."""
    kind, alphabet = rng.randrange(4), [f"w{k}" for k in range(rng.choice([1, 2, 3, 30]))]
    w = [rng.choice(alphabet) for _ in range(rng.randrange(60))]
    if kind:
        root = [rng.choice(alphabet) for _ in range(rng.randint(1, 12))]
        if kind == 2:
            root = root * rng.randint(1, 4) + [rng.choice(alphabet)]
        at = rng.randrange(len(w) + 1)
        w[at:at] = (root * rng.randint(3, 9))[: rng.randrange(200)]
        if kind == 3 and w:
            w[rng.randrange(len(w))] = "odd"
    return w


@pytest.mark.parametrize("least, times", [(6, 4), (20, 4), (4, 3), (1, 5)])
def test_runs_against_all_lags(least, times):
    rng = random.Random(least)
    texts = [[x.encode() for x in some_words(rng)] for _ in range(400)]
    found = periodic_runs.runs_of(texts, least, times)
    want = [plain_runs(w, least, times) for w in texts]
    assert [[(r.start, r.length, r.period) for r in f] for f in found] == want and sum(map(len, want)) > 200


def test_a_diagonal_is_extended_once(monkeypatch):
    calls = []
    real = periodic_runs._agreement
    monkeypatch.setattr(periodic_runs, "_agreement", lambda w, i, q: calls.append(q) or real(w, i, q))
    words = np.array(([0, 1, 2] * 30_000) + [3, 4] * 20_000)
    found = periodic_runs.find_runs(words)
    assert [(r.start, r.length, r.period) for r in found] == [(0, 90_000, 3), (90_000, 40_000, 2)] and sorted(calls) == [2, 3]


def plain_digest(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_digests_of_runs(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", "\t\x0c"]).join(some_words(rng))) for i in range(300)] + ODD
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    got = [tuple(r) for r in periodic_runs.digest(documents(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted((plain_digest(i, t) for i, t in rows), key=repr)
    assert periodic_runs.digest(documents(spark, [])).count() == 0


def test_runs_of_long_texts_and_collapsed_texts(spark):
    docs = documents(spark, [(7, "a b c " * 400_000), (8, " ".join(f"w{k}" for k in range(300_000))), (9, None), (11, "x y\n x y x y x y z z")])
    by = {r["doc_id"]: r for r in periodic_runs.digest(docs).collect()}
    assert (by[7]["start"], by[7]["length"], by[7]["period"]) == (0, 1_200_000, 3) and by[8]["n_runs"] == 0
    out = periodic_runs.collapse(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] != 8} == {7: "a b c", 9: None, 11: "x y z z"}
    assert sorted(tuple(r) for r in periodic_runs.runs(docs).collect()) == [(7, 0, 1_200_000, 3), (11, 0, 8, 2)]


# Spelling variants


def plain_spellings(rows):
    n = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate({65 + k: 97 + k for k in range(26)})
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and x != w and apart(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return [(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n]


def test_spellings(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcé", k=rng.randint(6, 10))) for _ in range(40)] + ["aaaaaaaa", "éàÿ×÷öß", "letters"]
    words = []
    for w in base:
        for _ in range(12):
            x = list(w)
            k = rng.randrange(len(x))
            x[k : k + 1] = rng.choice([[], [rng.choice("abcdé")], [x[k], rng.choice("abcdé")]])
            words.append("".join(x))
    rows = []
    for i in range(500):
        rows.append((i, rng.choice([" ", ", ", "1"]).join(rng.choice(base).upper() if rng.random() < 0.7 else rng.choice(words) for _ in range(30))))
    rows += ODD + [(None, "letters lettars lettars")] + [(900, "letterss " * 3000), (901, "lettersss " * 40), (902, "lettersssx " * 2), (903, "q" * 3000 + " " + "q" * 3001), (904, "q" * 3000 + " " + "q" * 3001)]
    got = [tuple(r) for r in spelling.spellings(documents(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = plain_spellings(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[4] for w in want) > 500 and any(w[1] and w[2] != w[1] for w in want)
    assert spelling.spellings(documents(spark, [])).count() == 0
    assert spelling.spellings(documents(spark, ODD)).count() == 0


def test_a_chain_of_forms_ends_at_its_root(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(19)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w19"}


def test_near_words_share_a_signature_and_every_pair_comes_once(spark):
    rng = random.Random(11)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(7, 9))) for _ in range(400)})
    pairs = [tuple(sorted((r["word_a"], r["word_b"]))) for r in spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()]
    cut = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cut[k, w[:k] + w[k + 1 :], len(w)].add(w)
    want = {tuple(sorted((a, b))) for c in cut.values() for a in c for b in c if a != b} | {tuple(sorted((w, w[:k] + w[k + 1 :]))) for w in words for k in range(len(w)) if w[:k] + w[k + 1 :] in set(words)}
    assert sorted(pairs) == sorted(want)
