"""Corpus operators against brute force on small tables with nulls, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from stackwright.llm import bpe, common, decontam, exact, graphs, langid, minhash, pii, quality, queries, substrings, tokencount, tokenfile

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


@pytest.fixture(scope="module")
def tok(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def texts():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamé", "delta,", "Epsilon", "zeta\n", "eta  eta", "x@y.example", "<|endoftext|>", "don't", "中文", "12,5"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    base = " ".join(f"w{i}" for i in range(120))
    near = [base.replace("w7 ", "v7 "), base.upper(), base, base + " tail of it"]
    return [None, "", "   ", "\n\t", "ab", *made, *made[:5], *near, "word " * 9000, "unbroken" * 9000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", None, 0.5, True) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, KINDS).repartition(3)


@pytest.fixture(scope="module")
def plain():
    return dict(enumerate(texts()))


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_bpe_is_the_library(spark, docs, plain, path, tok):
    got = by_id(bpe.round_trip(docs, path).select("doc_id", "ids", "decoded"))
    for i, t in plain.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, tok.decode(ids, skip_special_tokens=False)), i


def test_bpe_random_bytes(path, tok):
    rng = random.Random(1)
    made = ["".join(chr(rng.choice([32, rng.randint(32, 126), rng.randint(97, 105), rng.randint(0x80, 0x2FFF)])) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for encoder in (bpe.encoder(path), tokenfile.library_pieces(path)):
        ids, counts = encoder.encode(made)
        stops = np.cumsum(counts)
        for t, n, e in zip(made, counts, stops):
            assert ids[e - n : e].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = rng.integers(0, 1 << 16, n).astype(np.uint32)
        ids[rng.random(n) < 0.05] = 0xFFFFFFFF
        data, starts = tokenfile.pack_ids(ids)
        assert (tokenfile.unpack_ids(data, starts, n) == ids).all()


def test_token_files(spark, docs, plain, path, tok):
    got, start = by_id(tokenfile.round_trip(docs, path, 2)), 0
    for i in sorted(plain):
        ids = tok.encode(plain[i] or "", add_special_tokens=False).ids + [2]
        assert got[i] == (start, len(ids), zlib.crc32(array("I", ids).tobytes())), i
        start += len(ids)


def test_token_counts_with_tiny_chunks(spark, docs, plain, path, tok):
    expected = {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False)), len(tok.encode(t or "", add_special_tokens=False)) > 512) for i, t in plain.items()}
    assert by_id(tokencount.count_tokens(docs, path)) == expected
    assert by_id(tokencount.count_tokens(docs, path, whole=100, chunk=50, margin=4)) == expected


def test_token_counts_of_repeated_rows(spark, docs, path):
    twice = docs.where("doc_id > 20").union(docs.where("doc_id > 20"))
    counts = tokencount.count_tokens(twice, path, whole=100, chunk=50, margin=8)
    assert counts.count() == twice.count()
    assert counts.distinct().count() * 2 == twice.count()


def test_language_profiles(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = common.crc_mod(F.col("doc_id"), 5) == 0
    out = langid.predict(docs, langid.learn(docs, ~held), "doc_id", "lang", held.alias("held_out")).where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count()


def test_language_edges(spark, docs):
    nothing = langid.predict(docs, langid.learn(docs, F.lit(False)), "doc_id")
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    some = by_id(langid.predict(docs, langid.learn(docs, F.lit(True)), "doc_id"))
    assert some[0] == ("und", 0.0) and some[2] == ("und", 0.0) and some[4][0] == "en"
    assert all(0 <= s[1] <= 1 for s in some.values())
    langid.SLICE, before = 16, langid.SLICE
    try:
        a = langid.ngram_counts("the quick brown fox jumps over it")
    finally:
        langid.SLICE = before
    b = langid.ngram_counts("the quick brown fox jumps over it")
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_quality_rules(spark, sf, docs):
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.learn(table, labels, F.lit(True))
    out = quality.score(table, rules).join(labels.select("doc_id", "quality"), "doc_id")
    assert out.where("predicted = quality").count() >= 0.9 * out.count()
    scored = quality.score(docs.drop("score"), rules)
    assert scored.where("score between 0 and 1").count() == docs.count()
    none = quality.learn(table, labels.where("false"), F.lit(True))
    assert quality.score(docs.drop("score"), none).select(F.round("score", 3)).distinct().count() == 1
    assert quality.accepted(docs, rules).columns == docs.columns


def brute_substrings(plain, window):
    seen, out = set(), {}
    for i in sorted(plain):
        w = (plain[i] or "").encode().split()
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            t = tuple(w[k : k + window])
            if t in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(t)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(kept), b" ".join(kept).decode())
    return out


def test_substrings(spark, docs, plain):
    expected = brute_substrings(plain, substrings.WINDOW)
    assert by_id(substrings.dedup(docs)) == expected
    assert sum(x[1] for x in expected.values()) > 1000


def test_substrings_in_small_slices(spark, plain):
    expected = brute_substrings(plain, substrings.WINDOW)
    items = []
    before, substrings.SLICE_BYTES = substrings.SLICE_BYTES, 200
    try:
        for i, t in plain.items():
            data = b" ".join((t or "").encode().split())
            parts = list(substrings.slices(data))
            assert sum(len(p.split()) for _, p in parts) - (len(parts) - 1) * (substrings.WINDOW - 1) == len(data.split())
            items += [(i, 0, w, p) for w, p in parts]
    finally:
        substrings.SLICE_BYTES = before
    assert settled(items, 3) == {i: x[1] for i, x in expected.items() if x[1]}
    before = substrings.HELD_BYTES
    for held in (200, 3000):  # every bucket is settled in runs, and most are dealt again
        substrings.HELD_BYTES = held
        try:
            assert settled(items, 3) == {i: x[1] for i, x in expected.items() if x[1]}
        finally:
            substrings.HELD_BYTES = before


def settled(items, n_buckets):
    """Words gone of each document: the operator's steps without Spark."""
    gone, rows, level = defaultdict(set), [], 0
    for bucket, is_spans, payload in substrings.pack_group(items, n_buckets):
        if is_spans:
            rows.append((substrings._unpack(payload, 4)[0], None))
        else:
            rows.append((None, (bucket, payload)))
    while True:
        dealt = defaultdict(list)
        for spans, again in rows:
            if spans is None:
                dealt[again[0]].append(again[1])
            else:
                for i, _, a, b in zip(*spans):
                    gone[int(i)].update(range(a, b))
        if not dealt:
            return {i: len(g) for i, g in gone.items()}
        rows = []
        for name, payloads in dealt.items():
            bucket = substrings.Bucket(name, level)
            for p in payloads[::-1]:
                rows += bucket.add(p)
            rows += bucket.settle(last=True)
        level += 1


def test_one_minimiser_in_all_documents(spark, monkeypatch):
    # every window starts with the same run of words, so that all are in one bucket
    rng = random.Random(2)
    blocks = ["a a a a " + " ".join(f"w{rng.randint(0, 3000)}" for _ in range(16)) for _ in range(900)]
    plain = {i: " ".join(rng.choice(blocks) for _ in range(30)) for i in range(60)}
    items = [(i, 0, 0, t.encode()) for i, t in plain.items()]
    expected = {i: x[1] for i, x in brute_substrings(plain, substrings.WINDOW).items() if x[1]}
    monkeypatch.setattr(substrings, "HELD_BYTES", 20_000)
    assert settled(items, 1) == expected and expected


def test_substrings_of_repeated_and_null_ids(spark, plain):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (1, long), (1, long), (2, "x " + long + " y"), (None, None), (3, "")]
    got = sorted(map(tuple, substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))).select("doc_id", "n_words", "n_removed").collect()), key=repr)
    assert got == sorted([(None, 50, 0), (1, 50, 50), (1, 50, 50), (2, 52, 50), (None, 0, 0), (3, 0, 0)], key=repr)
    assert substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_hash_collisions_are_settled_by_bytes():
    words = substrings.Words(b" ".join(b"w%d" % (i % 23) for i in range(80)))
    windows = np.arange(len(words.starts) - substrings.WINDOW + 1)
    true = substrings.first_equal(words, words.window_hashes(), windows)
    assert (substrings.first_equal(words, np.zeros(len(windows), np.uint64), windows) == true).all()


def test_perfect_hash_is_a_bijection():
    for n in (1, 2, 5, 1000, 20_000):
        data = np.random.default_rng(n).integers(0, 256, (n, 32)).astype(np.uint8)
        pilots, slots = exact.build_hash(data)
        assert sorted(slots.tolist()) == list(range(n))
        assert (exact.slots_of(pilots, n, data) == slots).all()


def test_exact(spark, docs, plain, sf):
    groups = defaultdict(list)
    for i, t in plain.items():
        groups[hashlib.sha256((t or "").encode().lower()).digest()].append(i)
    expected = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert by_id(exact.dedup(docs).select("doc_id", "keep_id", "group_size", "kept")) == expected
    assert compare.differences(queries.op6_exact_dedup(spark, sf), sf, queries.ORACLES["op6_exact_dedup"]) == []
    assert exact.dedup(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "A"), (3, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r["keep_id"] or 0, r["group_size"]) for r in exact.dedup(odd).collect()) == [(0, 1), (3, 3), (3, 3), (3, 3)]


def brute_near(plain, size):
    upper = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for i, t in plain.items():
        w = (t or "").translate(upper).encode().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_near(spark, docs, plain, size):
    assert by_id(minhash.near_components(docs, size)) == brute_near(plain, size)


def test_near_edges(spark):
    odd = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "A b c d e"), (2, None), (3, "x y")], "doc_id long, text string")
    got = sorted((r["component_id"] if r["component_id"] is not None else -1, r["kept"]) for r in minhash.near_components(odd, 4).collect())
    assert got == [(-1, True), (1, True), (1, True), (2, True), (3, True)]
    assert minhash.near_components(odd.limit(0), 4).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, graphs.components(links).collect()))
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def test_decontamination(spark, sf):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([3, 7, 20, 40, 40])] + [(5, None), (6, "..."), (7, "a a a a a a a a b c d")]
    rows = []
    for i, (_, t) in enumerate(items):
        w = (t or "").split()
        filler = [rng.choice(words) for _ in range(30)]
        changed = list(w)
        if len(w) > 10:
            changed[1] = "zz"
        rows += [(10 * i, " ".join(filler + w + filler)), (10 * i + 1, " ".join(filler[:9] + changed).upper()), (10 * i + 2, " ".join(w[: len(w) // 2])), (10 * i + 3, ", ".join(w))]
    rows += [(900, None), (901, ""), (None, items[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontam.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}

    def split(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def bag(w):
        return Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])

    expected = {}
    for d, t in rows:
        w = split(t)
        for item, it in items:
            x = split(it)
            if not x or d is None or not w:
                continue
            best = 0
            for k in range(max(1, len(w) - len(x) + 1)):
                a, b = bag(w[k : k + len(x)]), bag(x)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                expected[d, item] = round(best, 9)
    assert got == expected and len(got) > 10
    assert decontam.matches(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_short_items_in_short_documents(spark):
    texts = ["b c d", "a b c d", "b c d a", "b c", "c d b", "a b", "b", "a a b c d", "b c d b c d"]
    items = [(1, "b c d"), (2, "b"), (3, "a b c d"), (4, "b c")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontam.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = {(d, i, f" {t} ".index(f" {x} ") // 2, 1.0) for d, t in enumerate(texts) for i, x in items if f" {x} " in f" {t} "}
    assert {(r["doc_id"], r["item_id"], r["start_word"], r["similarity"]) for r in found} == expected and len(found) == len(expected)


def test_items_that_repeat_a_shingle(spark):
    rng = random.Random(11)
    items = [(i, " ".join([f"w{rng.random():.9f}"[3:] for _ in range(184)] + ["a"] * 20)) for i in range(12)]
    docs = [(i, " ".join(t.split()[:184] + (["b"] * 20 if i % 2 else [f"v{i}x{k}" for k in range(20)]))) for i, t in items]
    found = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], round(r["similarity"], 6)) for r in found) == [(i, i, round(180 / 220, 6)) for i in range(12)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_personal_data(spark):
    rng = random.Random(3)
    parts = list("0123456789") + [".", " ", "-", "@", "+", "(", ")", "a", "b.c", "é", "\U0001f600", "\n", "1.2.3.4", "4111111111111111", "x@y.z", "+1 (982) 555-2127", "  "]
    plain = dict(enumerate(["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [None, "", "1" * 20000, "1 " * 20000, "a." * 20000 + "@"]))
    docs = spark.createDataFrame(list(plain.items()), "doc_id long, text string").withColumn("email", F.lit("x")).repartition(4)
    got = {r["doc_id"]: r["base"] for r in pii.find(docs).collect()}
    for i, t in plain.items():
        found = sorted((m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "" if len(t or "") < 1000 else "") if passes(k, m.group()))
        if len(t or "") < 1000:
            assert got[i] == ",".join(x[2] for x in found), (i, t)


def test_contextual_discovery(spark):
    known = [f"call {i} mail nick{i}@mail.example.org now" for i in range(40)]
    rows = list(enumerate([*known, "we mail 77abc-99xyz today", "we sent 77abc-99xyz today", "mail short1 x"]))
    got = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "spans"))
    assert got[40] == ("like_email:8:19",) and got[41] == ("",) and got[42] == ("",)
    assert got[0][0].startswith("email:")


def discovered(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: re.findall(r"like_[^,]*", r["spans"]) for r in pii.find(rows).collect() if "like_" in r["spans"]}


def test_ordinary_words_count_against_a_pattern(spark):
    seeds = [f"to nick{i}@mail.example.org" for i in range(60)]
    assert discovered(spark, [*seeds, "to 77abc-99xyz"]) == {60: ["like_email:3:14"]}
    assert discovered(spark, [*seeds, "to 77abc-99xyz", "we go to town " * 7]) == {}
    assert discovered(spark, [*["to=" + s[3:] for s in seeds], "to=77abc-99xyz", "to=town " * 7]) == {}
    assert discovered(spark, [*seeds, "to 77abc-99xyz", "so to id=5 go " * 7]) == {}
    assert discovered(spark, [*seeds, "to 77abc-99xyz", *[f"to {i}" for i in range(7)]]) == {}


def test_a_pattern_does_not_speak_for_itself(spark):
    seeds, unseen = [f"the nick{i}@mail.example.org" for i in range(24)], [f"the {i}abc-99xyz" for i in range(10)]
    assert discovered(spark, seeds + unseen) == {}
    # what a trusted pattern is for speaks for the same instance elsewhere, unless that is mostly used otherwise
    sure = [f"mail {i}ick@mail.example.org" for i in range(90)] + [f"mail {i}abc-99xyz" for i in range(10)]
    assert set(discovered(spark, seeds + unseen + sure)) == {*range(24, 34), *range(124, 134)}
    assert set(discovered(spark, seeds + unseen + sure + [f"so {i}abc-99xyz" for i in range(10)])) == {*range(124, 134)}


def test_patterns_are_trusted_alike_at_every_size(spark):
    good = [f"mail nick{i}@mail.example.org" for i in range(9)] + ["mail 77abc-99xyz"]
    bad = [f"on nick{i}@mail.example.org" for i in range(8)] + ["on 88abc-99xyz"]
    for times in (1, 5):
        assert set(discovered(spark, (good + bad) * times)) == {9 + 19 * k for k in range(times)}


def test_every_base_match_is_a_seed(spark):
    names = [f"nick{chr(97 + i)}" for i in range(20)]
    assert discovered(spark, [*[f"mail {n}@mail.example.org now" for n in names], "mail 77abc-99xyz"]) == {20: ["like_email:5:16"]}
    phones = [f"call: +1 (982) 555-{2100 + i} now" for i in range(20)]
    assert discovered(spark, [*phones, "call 77abc-99xyz"]) == {20: ["like_phone:5:16"]}
    pairs = [f"mail {n}@a.example.org,{n}@b.example.org" for n in names[:5]]
    assert discovered(spark, [*pairs, "mail 77abc-99xyz"]) == {5: ["like_email:5:16"]}


def test_a_word_is_the_pattern_of_all_in_the_run_after_it(spark):
    runs = [f"mail {' ' * 90}nick{i}@a.example.org nick{i}@b.example.org" for i in range(20)]
    assert discovered(spark, [*runs, "mail 77abc-99xyz 88abc-99xyz"]) == {20: ["like_email:5:16", "like_email:17:28"]}
    long = "mail " + " ".join(f"nick{i}@a.example.org" for i in range(3 * pii.RUN)) + " 77abc-99xyz"
    assert discovered(spark, [long]) == {0: [f"like_email:{len(long) - 11}:{len(long)}"]}


def test_long_documents_have_no_quadratic_patterns(spark):
    long = "a" * 200_000 + " " + "1." * 50_000 + "+1" + "(" * 50_000
    assert pii.find(spark.createDataFrame([(1, long)], "doc_id long, text string")).count() == 1
