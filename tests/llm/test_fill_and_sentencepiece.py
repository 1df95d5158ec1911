"""Fill-in-middle against a plain list of units and DuckDB, SentencePiece against the library."""

import random
import re
import tracemalloc
from collections import Counter
from hashlib import sha256

import compare
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_edges import ROWS, odd  # noqa: F401

from stackwright.llm import fillmiddle, queries, sentencepieces

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model_path):
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def plain_fill(doc_id, text):
    """The contract over a list of all units."""
    text = text or ""
    units = re.findall(UNITS, text)
    assert "".join(units) == text
    digest = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, out[0], len(p), len(m), out[1], text


def filled(df):
    return Counter(tuple(r) for r in fillmiddle.fill_in_middle(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect())


def test_fill_in_middle_on_odd_rows(odd):  # noqa: F811
    assert filled(odd) == Counter((d, *plain_fill(d, t)) for d, t in ROWS)
    assert fillmiddle.fill_in_middle(odd.limit(0)).count() == 0


def test_fill_in_middle_of_random_texts(spark):
    rng = random.Random(3)
    letters = ["a", "é", "中", "😀", " ", "\t", "\n", "\r", "\x0b", "\x1c", " ", "<", ">", "S", "P", "M", "\x00", "<S", "M>"]
    rows = [(i, "".join(rng.choices(letters, k=rng.choice([0, 1, 2, 9, 60])))) for i in range(1500)] + [(7, "x" * 300_000), (8, " " * 300_000), (9, "a b" * 200_000)]
    got = filled(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == Counter((d, *plain_fill(d, t)) for d, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_parameters_of_fill_in_middle():
    text = "one two  three four"
    assert all(fillmiddle.transform(text, i, rate=0)[1] == "plain" for i in range(50))
    assert {fillmiddle.transform(text, i, rate=100, spm_rate=0)[1] for i in range(50)} == {"psm"}
    assert {fillmiddle.transform(text, i, rate=100, spm_rate=100)[1] for i in range(50)} == {"spm"}
    assert len({fillmiddle.transform(text, 1, seed=s, rate=100)[4] for s in range(50)}) > 5


def test_matcher_needs_no_memory_for_units():
    text = "ab " * 400_000
    tracemalloc.start()
    n = fillmiddle.count_units(text)
    places = fillmiddle.cut_places(text, n // 3, n // 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, *places) == (400_001, 133_333 * 3 - 1, 200_000 * 3 - 1)
    assert peak < 20_000  # a list of the units would take over 20 million bytes


def test_fill_in_middle_is_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare.differences(queries.op11_fill_in_middle(spark, sf), sf, queries.ORACLES["op11_fill_in_middle"]) == []


def test_sentencepiece_on_odd_rows(odd, model_path, library):  # noqa: F811
    ids = [library.encode(t or "", add_bos=True, add_eos=True) for _, t in ROWS]
    expected = Counter((d, len(i), tuple(i), library.decode(i)) for (d, _), i in zip(ROWS, ids))
    got = sentencepieces.round_trip(odd, model_path).collect()
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in got) == expected
    packed = sentencepieces.round_trip(odd, model_path, packed=True).collect()
    assert Counter((r["doc_id"], r["n_tokens"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"]) for r in packed) == expected
    assert sentencepieces.round_trip(odd.limit(0), model_path).count() == 0


def same_as_library(table, library, texts):
    ids, counts = table.encode(texts)
    for text, n, end in zip(texts, counts.tolist(), np.cumsum(counts).tolist()):
        expected = library.encode(text, add_bos=True, add_eos=True)
        assert ids[end - n : end].tolist() == expected, text
        assert table.decode(ids[end - n : end]) == library.decode(expected), text


def test_sentencepiece_of_random_texts(model_path, library):
    rng, table = random.Random(5), sentencepieces.load(model_path)
    letters = [*"abc  ▁eiou\n\t0123xyzthe\x00é中文字😀ÅﬁABC.,'\"-_/", "́", "  ", "the", "ing"]
    for _ in range(150):
        same_as_library(table, library, ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 5, 50, 500]))) for _ in range(20)])
    for _ in range(40):
        runs = [c * rng.randint(1, 300) for c in ("a", " ", "the", "=", "-", "ab")]
        same_as_library(table, library, [*runs, *("".join(rng.choices("aab ", k=200)) for _ in range(5))])


def test_sentencepiece_of_words_run_together(spark, sf, model_path, library):
    """Long words of real syllables, where merges depend on each other most."""
    rng, table = random.Random(6), sentencepieces.load(model_path)
    words = " ".join(r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()).split()
    for _ in range(60):
        same_as_library(table, library, ["".join(rng.choices(words, k=rng.choice([2, 5, 40, 200]))) for _ in range(4)])


def test_sentencepiece_in_small_slices(model_path, library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "GROUP_CHARS", 50)
    rng, table = random.Random(7), sentencepieces.load(model_path)
    for _ in range(60):
        same_as_library(table, library, ["".join(rng.choices("thequick brown 中é\n", k=rng.choice([51, 70, 700])))])


def test_words_that_leave_the_memo(model_path, library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "MEMO_WORDS", 3)
    table = sentencepieces.load.__wrapped__(model_path)
    for _ in range(3):
        same_as_library(table, library, ["some words of a text", "other words, and more", "x" * 100])


def test_decoding_of_any_ids(model_path, library):
    rng, table = random.Random(8), sentencepieces.load(model_path)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randint(0, 12))]
        assert table.decode(np.array(ids, np.uint32)) == library.decode(ids), ids


def test_sentencepiece_query(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    expected = {}
    for d, t in rows:
        ids = library.encode(t, add_bos=True, add_eos=True)
        expected[d] = (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in queries.op12_sentencepiece(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == expected
