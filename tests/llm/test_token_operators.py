from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest

from quillon.llm import binary_output, bpe, token_count
from quillon.llm.registry import QUERIES

JSON_WORD, JSON_BYTE, RANKS = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def counts(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(JSON_WORD))
    t.no_truncation()
    t.no_padding()
    sizes = [len(e.ids) for e in t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)]
    return Counter((d, len((x or "").encode()), n, n > 2048) for (d, x), n in zip(rows, sizes, strict=True))


def codes(rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(RANKS), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for d, x in rows:
        ids = e.encode_ordinary(x or "")
        out[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()] += 1
    return out


def files(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(JSON_BYTE))
    out, at = [], 0
    for (d, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False), strict=True):
        ids = [*e.ids, 2]
        out.append((d, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def got(df):
    return Counter(map(tuple, df.collect()))


def test_token_counts(tricky, empty):
    path = P.path(JSON_WORD)
    assert got(token_count.count_tokens(tricky, path)) == counts(pairs(tricky))
    assert token_count.count_tokens(empty, path).count() == 0


@pytest.mark.parametrize("text", ["ΑΣ ΟΔΟΣ", "İstanbul K Å ﬁ", "éè  x y", "don't I'LL 'S 's's", "a<|endoftext|>b <|startoftext|>", "İıǅ ß ẞ", "🙂👍🏽 𝔘𝔫𝔦", "12٣４ ½²", "x\u0000y\u001cz\u0085w", "Σ"])
def test_token_counts_of_odd_texts(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(JSON_WORD))
    assert token_count.TextCounter(P.path(JSON_WORD)).text(text) == len(t.encode(text, add_special_tokens=False).ids)


def test_special_strings_in_another_case(spark):
    texts = ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "A<|endoftext|>B <|STARTOFTEXT|><|endoftext|>", "<|endoftext|>", "X<|Y É<|endoftext|>É", "a<", "|b"]
    rows = list(enumerate(texts))
    assert got(token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), P.path(JSON_WORD))) == counts(rows)


def test_byte_bpe(tricky, empty):
    path = P.path(RANKS)
    assert got(bpe.encode_documents(tricky, path, P.PATTERN, with_ids=False)) == codes(pairs(tricky))
    assert bpe.encode_documents(empty, path, P.PATTERN).count() == 0


def test_token_files(spark, tricky, empty):
    unique = tricky.where("doc_id is not null").dropDuplicates(["doc_id"])
    parts = binary_output.write_token_files(unique, P.path(JSON_BYTE), 2, length=64).collect()
    rows = sorted(pairs(unique))
    assert got(binary_output.read_token_files(parts, spark, 64)) == Counter(files(rows))
    for r in parts:
        table = binary_output.open_arrow(r.ids_path).read_all()
        assert table.schema.field("ids").type == pa.list_(pa.uint16(), 64)
        assert sum(sum(m) for m in table["mask"].to_pylist()) == r.n_ids
    all_rows = binary_output.read_token_files(binary_output.write_token_files(tricky, P.path(JSON_BYTE), 2).collect(), spark)
    assert all_rows.count() == tricky.count()
    assert binary_output.read_token_files(binary_output.write_token_files(empty, P.path(JSON_BYTE), 2).collect(), spark).count() == 0


def test_queries(spark, sf):
    rows = sorted(pairs(spark.read.parquet(f"{sf}/documents.parquet")))
    assert got(QUERIES["op6_token_counts"](spark, sf)) == counts(rows)
    assert got(QUERIES["op10_byte_bpe"](spark, sf)) == codes(rows)
    assert got(QUERIES["op8_token_files"](spark, sf)) == Counter(files(rows))


def test_ids_above_two_bytes(spark, tricky, tmp_path):
    """A vocabulary of 70,000 entries whose letters have the largest ids."""
    import json

    letters = bpe.byte_letters()
    vocabulary = {f"filler{i}": i for i in range(70_000 - len(letters))} | {c: 70_000 - len(letters) + i for i, c in enumerate(letters)}
    spec = {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "truncation": None, "padding": None,
            "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "vocab": vocabulary, "merges": []}}
    path = str(tmp_path / "wide.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    assert binary_output.id_dtype(path, 2).__name__ == "uint32" and binary_output.id_dtype(P.path(JSON_BYTE), 2).__name__ == "uint16"
    parts = binary_output.write_token_files(tricky, path, 2).collect()
    found = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in binary_output.read_token_files(parts, spark).collect()}
    crc = lambda raw: zlib.crc32(b"".join((vocabulary[letters[b]]).to_bytes(4, "little") for b in raw) + (2).to_bytes(4, "little"))
    assert found == {(d, len((t or "").encode()) + 1, crc((t or "").encode())) for d, t in pairs(tricky)}
    assert {r.ids_crc32 for r in binary_output.read_token_files(parts, spark).where("doc_id = 7").collect()} == {crc(dict(pairs(tricky))[7].encode())}


def test_specials_in_any_case_and_long_words(spark):
    """Against the library: special strings in other cases, and pre-tokens of many blocks."""
    import random

    rng = random.Random(9)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|", "|>", "word", "Straße", "É", "don't", "12", "...", " ", "\n", "東京"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts += ["a" * 300_000, "".join(rng.choice("abcdefgh") for _ in range(50_000)), "é" * 9000 + "x" + "banana" * 4000, "x" * 4096, "x" * 4097, "1" * 20_000 + "!" * 20_000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(token_count.count_tokens(df, P.path(JSON_WORD))) == counts(rows)


def test_clashing_columns_and_empty_tables(spark, tricky, empty):
    clash = tricky.select("doc_id", "text", tricky.a.alias("n_tokens"), tricky.t.alias("ids"), tricky.t.alias("n_bytes"))
    assert got(token_count.count_tokens(clash, P.path(JSON_WORD))) == got(token_count.count_tokens(tricky, P.path(JSON_WORD)))
    encoded = bpe.encode_documents(clash, P.path(RANKS), P.PATTERN, with_ids=False)
    assert got(encoded) == codes(pairs(tricky))
    assert token_count.count_tokens(empty, P.path(JSON_WORD)).count() == 0
    assert bpe.encode_documents(empty, P.path(RANKS), P.PATTERN).count() == 0
    one, two = (Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in binary_output.read_token_files(binary_output.write_token_files(x, P.path(JSON_BYTE), 2).collect(), spark).collect()) for x in (clash, tricky))
    assert one == two


def test_a_text_above_a_slice(spark):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice(["some ", "words, ", "and\n", "números ", "x" * 40]) for _ in range(150_000)), "-=" * 600_000, "short"]
    rows = list(enumerate(texts))
    assert len(texts[0]) > 1 << 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(token_count.count_tokens(df, P.path(JSON_WORD))) == counts(rows)
    assert got(bpe.encode_documents(df, P.path(RANKS), P.PATTERN, with_ids=False)) == codes(rows)
    parts = binary_output.write_token_files(df, P.path(JSON_BYTE), 2).collect()
    assert sorted(map(tuple, binary_output.read_token_files(parts, spark).collect())) == sorted(files(rows))
