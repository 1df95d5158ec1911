"""Null, repeated, empty and clashing rows for every operator, and operators against plain Python."""

import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import by_id, discovered

from stackwright.llm import bpe, common, decontam, exact, hashing, langid, minhash, pieces, pii, quality, queries, tokencount, tokenfile

LONG = " ".join(f"w{i} is" for i in range(40))
ROWS = [(None, LONG), (None, "short one"), (1, LONG), (1, LONG), (1, "other text of one id"), (2, None), (2, ""), (3, "The END."), (3, "The END."), (4, LONG.upper() + " " * 3000 + "x" * 200_000)]
NAMES = ["key", "key2", "_key", "_nth", "start", "item_id", "n", "lang", "score", "predicted", "_s_n_words", "_keep", "_leak", "band", "ids", "tokens", "digest", "sig", "base", "w"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({n: F.lit(1) for n in NAMES}).repartition(2).cache()


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


@pytest.fixture(scope="module")
def tok(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def rows_of(df, *columns):
    return Counter(map(tuple, df.select(*columns).collect()))


def test_encoders_on_odd_rows(spark, odd, path, tok):
    ids = [tok.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    coded = bpe.round_trip(odd, path)
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in coded.collect())
    assert got == Counter((d, tuple(i), t or "") for (d, t), i in zip(ROWS, ids))
    assert rows_of(tokencount.count_tokens(odd, path), "doc_id", "n_bytes", "n_tokens") == Counter((d, len((t or "").encode()), len(i)) for (d, t), i in zip(ROWS, ids))
    written = tokenfile.round_trip(odd, path, 2).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in written) == Counter((d, len(i) + 1, zlib.crc32(array("I", [*i, 2]).tobytes())) for (d, _), i in zip(ROWS, ids))
    assert [r["start"] for r in written] == np.cumsum([0] + [r["n_tokens"] for r in written])[:-1].tolist()
    places = [r["doc_id"] if r["doc_id"] is not None else -1 for r in written]
    assert places == sorted(places)
    none = odd.limit(0)
    assert bpe.round_trip(none, path).count() == tokencount.count_tokens(none, path).count() == tokenfile.round_trip(none, path, 2).count() == 0


def test_memo_tells_equal_hashes_apart(path, tok, monkeypatch):
    monkeypatch.setattr(pieces, "range_hashes", lambda raw, starts, ends: hashing.range_hashes(raw, starts, ends) % np.uint64(97) + np.uint64(1))
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde,.é1") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    encoder = bpe.encoder.__wrapped__(path)
    encoder.memo = pieces.Memo(bpe.load(path).data, 1 << 8)  # also emptied when full
    for _ in range(6):
        texts = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(20)]
        ids, counts = encoder.encode(texts)
        for t, n, e in zip(texts, counts, np.cumsum(counts)):
            assert ids[e - n : e].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_files_grow_in_number_with_bytes(spark, path, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 2000)
    docs = spark.createDataFrame([(i, "some words and more " * 20) for i in range(100)] + [(None, "x")] * 50, "doc_id long, text string")
    back = tokenfile.round_trip(docs, path, 2)
    got = back.orderBy("start").collect()
    assert len(got) == 150 and [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert [r["doc_id"] for r in got] == [None] * 50 + list(range(100))


def test_out_of_place_distance(spark):
    texts = {"a": "the quick brown fox and the dog", "b": "der schnelle braune fuchs und der hund", "c": "le renard brun rapide et le chien"}

    def profile(text, most):
        t, grams = " ".join(re.findall(r"[^\W\d_]+", text.lower())), Counter()
        t = f" {t} "
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                g = t[i : i + n]
                if not (g == " " or n == 3 and g[1] == " "):
                    grams[g] += 1
        code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g))
        return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))][:most]

    train = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    profiles = langid.learn(train, F.lit(True))
    ranks = {k: {g: i for i, g in enumerate(profile(t, langid.PROFILE))} for k, t in texts.items()}
    for t in ["the dog and the fox", "der hund", "le chien", "zzz", "x"]:
        doc = profile(t, langid.DOC_PROFILE)
        off = {k: sum(abs(r[g] - i) if g in r else langid.PROFILE for i, g in enumerate(doc)) for k, r in ranks.items()}
        best = min(off, key=lambda k: (off[k], k))
        assert profiles.predict(t) == (best, pytest.approx(1 - off[best] / (langid.PROFILE * len(doc))))
    same = langid.Profiles({"b": [97], "a": [97]})
    assert same.predict("a")[0] == "a"


def test_language_and_quality_on_odd_rows(spark, odd, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    profiles = langid.learn(docs, F.lit(True))
    found = langid.predict(odd, profiles, "doc_id", F.md5("text").alias("hash"))
    assert found.count() == len(ROWS) and found.select("hash", "lang_pred", "score").distinct().count() == len({t for _, t in ROWS})
    assert found.where("doc_id = 2").select("lang_pred").distinct().collect() == [("und",)]
    assert langid.predict(odd.limit(0), profiles, "doc_id").count() == 0
    rules = quality.learn(docs, labels, F.lit(True))
    scored = quality.score(odd.withColumn("hash", F.md5(F.coalesce("text", F.lit("")))), rules)
    assert set(scored.columns) == {*odd.columns, "hash"} - {"text"} and scored.count() == len(ROWS)
    expected = {}
    for _, t in ROWS:
        x = quality.text_stats((t or "").encode())
        total = rules.base + sum(w for r, w in rules.rules if all(x[s] <= c if most else x[s] > c for s, most, c in r))
        expected[t or ""] = 1 / (1 + math.exp(-total))
    import hashlib

    for r in scored.collect():
        p = next(p for t, p in expected.items() if hashlib.md5(t.encode()).hexdigest() == r["hash"])
        assert r["score"] == pytest.approx(p) and r["predicted"] == int(p >= quality.CUT)
    assert quality.accepted(odd, rules).columns == odd.columns
    assert quality.score(odd.limit(0), rules).count() == quality.accepted(odd.limit(0), rules).count() == 0


def test_exact_on_odd_rows(odd):
    groups = defaultdict(list)
    for d, t in ROWS:
        groups[(t or "").lower()].append(d)
    expected = Counter((d, max((x for x in groups[(t or "").lower()] if x is not None), default=None), len(groups[(t or "").lower()])) for d, t in ROWS)
    assert rows_of(exact.dedup(odd), "doc_id", "keep_id", "group_size") == expected


def test_classes_that_share_half_a_key(spark):
    rows = spark.createDataFrame([(i, 3, k, k2) for i, (k, k2) in enumerate([(7, 1), (7, 2), (7, 1), (8, 1), (9, 5)])], "doc_id long, n_shingles long, key long, key2 long")
    classes = rows.groupBy("key", "key2").agg(F.min("doc_id").alias("rep")).withColumn("half", F.col("key"))
    rows, classes = minhash.told_apart(rows, classes)
    assert classes.select("key").distinct().count() == 4 and {r["half"] for r in classes.collect()} == {7, 8, 9}
    names = {r["doc_id"]: r["key"] for r in rows.collect()}
    assert names[0] == names[2] != names[1] and names[3] == 8 and names[4] == 9


def test_blocks_give_each_pair_once(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, minhash.FINE_LANES // 64)
    fine = {k: [int(w) ^ (1 << int(rng.integers(0, 62))) for w in base] for k in range(60)}
    buckets = [(b, k, k // 2, 10) for b in range(3) for k in range(60) if (k + b) % 3 < 2]
    df = spark.createDataFrame(buckets, "band long, key long, component long, n long")
    sigs = spark.createDataFrame(list(fine.items()), "key long, fine array<long>")
    bands = defaultdict(set)
    for b, k, *_ in buckets:
        bands[k].add(b)
    expected = {(x, y) for x in range(60) for y in range(x) if x // 2 != y // 2 and bands[x] & bands[y]}
    for block in (7, 1000):
        got = [tuple(r) for r in minhash.pairs_across(df, sigs, block).collect()]
        assert set(got) == expected and len(got) == len(expected)


def brute_decontamination(rows, items):
    def split(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def bag(w):
        return Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])

    out = {}
    for d, t in rows:
        w = split(t)
        for item, it in items:
            x, b = split(it), bag(split(it))
            if not x or d is None or not w:
                continue
            for k in range(max(1, len(w) - len(x) + 1)):
                a = bag(w[k : k + len(x)])
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= 0.8 and s > out.get((d, item), (0, 0))[0]:
                    out[d, item] = (s, k)
    return out


def test_decontamination_of_items_of_all_lengths(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([5, 6, 9, 15, 31, 60, 120, 300, 300, 2, 4])]
    rows = []
    for _ in range(60):
        _, t = rng.choice(items)
        w = t.split()
        for _ in range(rng.randint(0, max(1, len(w) // 25))):  # about the threshold
            w[rng.randrange(len(w))] = rng.choice(words)
        a, b = rng.randint(0, len(w) // 12), rng.randint(0, len(w) // 12)
        rows.append((len(rows), " ".join([*(rng.choice(words) for _ in range(rng.randint(0, 40))), *w[a : len(w) - b], *(rng.choice(words) for _ in range(rng.randint(0, 40)))])))
    rows += [(900, items[7][1] + " " + items[5][1]), (901, items[6][1] + " " + items[6][1])]
    docs = spark.createDataFrame([*rows, rows[-1], rows[0], (None, items[3][1]), (950, None)], "doc_id long, text string").withColumns({n: F.lit(0) for n in ("item_id", "n_words", "key", "start", "w")})
    bench = spark.createDataFrame([*items, items[0], (None, "x y z"), (99, None)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start_word"]) for r in decontam.matches(docs, bench).collect()}
    expected = {k: (round(s, 9), at) for k, (s, at) in brute_decontamination(rows, items).items()}
    assert got == expected and len(got) > 30
    assert decontam.matches(docs, bench.limit(0)).count() == 0


def secret_texts(rng):
    value = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    return value, [f'set token = "{value(40)}" here' for _ in range(80)] + [f"key: {value(32)}; and" for _ in range(60)]


def test_assigned_values_teach_names(spark):
    rng = random.Random(9)
    value, texts = secret_texts(rng)
    n = len(texts)
    texts += ["a token hunter2-winter goes", 'a token = "hunter3-summer" goes', "the key: abc-12345 goes", "an id abc-12345678 goes", value(40)]
    texts += [t.replace("set token = ", "sent ") for t in texts[:6]]  # known values without their name
    places = {k: i for i, k in enumerate(["bare", "quoted", "short", "other", "alone", "known"], n)}
    rows = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (500, None), (501, ""), (None, texts[1])], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = [(r["doc_id"], r["spans"]) for r in pii.find(rows).collect()]
    assert len(got) == len(texts) + 4
    spans = dict(got)
    kinds = [re.fullmatch(r"(secret|like_secret):\d+:\d+", spans[i])[1] for i in range(n)]
    assert min(Counter(kinds).values()) > n // 4  # seeds, and those that the seeds' contexts discover
    assert spans[places["bare"]] == "like_secret:8:22" and spans[places["quoted"]] == "like_secret:11:25"
    assert spans[places["short"]] == "like_secret:9:18" and spans[places["other"]] == spans[places["alone"]] == ""
    assert [spans[places["known"] + i].split(":")[0] for i in range(6)] == kinds[:6] and len(set(kinds[:6])) == 2
    assert spans[500] == spans[501] == "" and spans[None] == spans[1]
    assert pii.find(rows.limit(0)).count() == 0


def test_planted_secrets_are_discovered(spark):
    """Half of the planted secrets are no seeds: the patterns that the other half teaches find nine of ten at least, and no
    token that is none."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("text like '%=%' or doc_id % 10 = 0").repartition(8)
    spans = by_id(pii.find(docs).select("doc_id", "spans"))
    planted, found, others = 0, Counter(), 0
    for r in docs.collect():
        own = {(int(a), int(b)): k for k, a, b in (s.split(":") for s in spans[r["doc_id"]][0].split(",") if s) if k not in pii.KINDS}
        for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r["text"] or ""):
            planted += 1
            found[own.pop(m.span(1), None)] += 1
        others += len(own)
    seeds = found["secret"]
    assert planted > 100 and 0.3 * planted < seeds < 0.7 * planted and others == 0
    assert found["like_secret"] >= 0.9 * (planted - seeds)


def plain_scores(found, seen):
    """The scoring of patterns in plain Python, from candidates and from how often a pattern stands in the texts."""
    edges = {}
    for r in found:
        e = edges.setdefault((r["word"], r["sign"], r["prev"], r["instance"]), {"kind": None, "shape": r["shape"], "n": 0, "free": 0})
        e["kind"], e["n"], e["free"] = e["kind"] or r["kind"], e["n"] + 1, e["free"] + (not r["lead"])
    uses, words, seeds = Counter(), defaultdict(set), set()
    for (word, _, _, x), e in edges.items():
        uses[x] += e["n"]
        words[x].add(word)
        if e["kind"]:
            seeds.add(x)
    is_open = lambda x: x not in seeds and len(x) >= pii.LENGTH
    long = defaultdict(dict)  # pattern -> (word, sign, prev, instance) -> edge
    for (word, sign, prev, x), e in edges.items():
        for p in [word, *([word + sign] if sign else []), *([f"{prev} {word}"] if prev else [])]:
            long[p][word, sign, prev, x] = e
    long = {p: es for p, es in long.items() if any(k[3] in seeds for k in es) and any(is_open(k[3]) for k in es)}
    confidence, trusted = {}, {}
    for _ in range(pii.ROUNDS):
        trusted = {}
        for p, es in long.items():
            shapes, one = {e["shape"] for k, e in es.items() if k[3] in seeds}, defaultdict(lambda: [0.0, False, 0])
            for (word, _, _, x), e in es.items():
                one[x][0] = 1.0 if x in seeds else confidence.get((x, word), 0.0)
                one[x][1] |= is_open(x) and len(words[x]) == 1 and e["shape"] in shapes
                one[x][2] += e["n"]
            free = sum(e["free"] for e in es.values())
            seed_n, seed_uses = sum(x in seeds for x in one), sum(v[2] for x, v in one.items() if x in seeds)
            vouched = min(sum(v[1] for v in one.values()), pii.VOUCHED * seed_n), min(sum(v[2] for v in one.values() if v[1]), pii.VOUCHED * seed_uses)
            every = max(sum(v[2] for v in one.values()), free + seen.get(p, 0))
            score = min(sum(v[0] for v in one.values()) / (len(one) - vouched[0]), sum(v[0] * v[2] for v in one.values()) / (every - vouched[1]))
            if score >= pii.CONFIDENT:
                trusted[p] = score
        said, own, own_said = Counter(), Counter(), Counter()
        for (word, sign, prev, x), e in edges.items():
            if is_open(x):
                best = max([trusted.get(p, 0.0) for p in [word, *([word + sign] if sign else []), *([f"{prev} {word}"] if prev else [])]])
                own[x, word] += e["n"]
                own_said[x, word] += best * e["n"]
                said[x] += best * e["n"]
        confidence = {(x, w): (said[x] - own_said[x, w]) / (uses[x] - n) if uses[x] > n else 0.0 for (x, w), n in own.items()}
    return trusted


def test_scores_are_those_of_plain_python(spark, monkeypatch):
    monkeypatch.setattr(pii, "CONFIDENT", 0.4)  # so that many patterns speak for instances
    rng = random.Random(12)
    value, texts = secret_texts(rng)
    mails, values = [f"nick{i}@mail.example.org" for i in range(60)], [value(40) for _ in range(60)]
    others = [f"{i}abc-99xyz" for i in range(12)] + [f"{i}" for i in range(9)]
    usual = {"mail": mails, "we mail": mails, "so mail": mails, "token =": values, "token:": values, "key=": values, "the": mails + values + others, "id": others}
    one = lambda head: f"{head} {rng.choice(others if rng.random() < 0.02 else usual[head])}"
    texts += [" ".join(one(rng.choice([*usual])) for _ in range(rng.randint(1, 5))) + rng.choice([" goes", " the end", ""]) for _ in range(500)]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[3])], "doc_id long, text string").repartition(4)
    found = pii.candidates(pii.find_base(docs)).cache()
    rows = found.collect()
    every = {p for r in rows for p in [r["word"], *([r["word"] + r["sign"]] if r["sign"] else []), *([f"{r['prev']} {r['word']}"] if r["prev"] else [])]}
    able = spark.createDataFrame([(p.split(" ")[-1].rstrip("=:"), p) for p in every], "word string, pattern string")
    seen = {r["pattern"]: r["seen"] for r in pii.occurrences(docs, able).collect()}
    got = {r["pattern"]: r["score"] for r in pii.learn_patterns(found, docs).collect()}
    assert got == pytest.approx(plain_scores(rows, seen)) and len(got) > 5
    assert len({r["kind"] for r in rows}) > 2


def test_base_spans_of_long_texts(spark):
    """Texts of some thousand characters, against re."""
    from test_operators import PATTERNS, passes

    rng = random.Random(14)
    parts = [*"0123456789", ".", " ", "-", "@", "+", "(", ")", "a", "b.c", "é", "\U0001f600", "\n", "1.2.3.4", "4111111111111111", "x@y.z", "+1 (982) 555-2127", "some words ", " " * 30, "x" * 50]
    plain = dict(enumerate("".join(rng.choices(parts, k=rng.choice([800, 3000, 9000]))) for _ in range(40)))
    got = {r["doc_id"]: r["base"] for r in pii.find(spark.createDataFrame(list(plain.items()), "doc_id long, text string").repartition(4)).collect()}
    for i, t in plain.items():
        found = sorted((m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if passes(k, m.group()))
        assert got[i] == ",".join(x[2] for x in found)


def test_context_is_looked_up_in_all_of_the_gap(spark):
    seeds = [f"we mail nick{i}@mail.example.org" for i in range(20)]
    for blanks in (20, 100, 5000):
        assert discovered(spark, [*seeds, "we mail" + " " * blanks + "77abc-99xyz"]) == {20: [f"like_email:{7 + blanks}:{18 + blanks}"]}


def test_names_that_no_column_has():
    assert common.free_name(["a", "_KEEP", "_keep_x"], "_keep") == "_keep__"
