"""Token counts and packing against whole encodings and an exact round trip."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillgrid.llm import packing, token_counts, tokens
from tillgrid.llm.queries import QUERIES


@pytest.fixture(scope="module")
def encode():
    own = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda x: own.encode(x or "", add_special_tokens=False).ids


def test_ranks_give_the_vocabulary_s_ids(encode, odd):
    texts = [t or "" for _, t in odd] + ["it's we'll I'D  two  spaces\n\n\ttab ¼ ② Ⅷ ٣ é ​ x_y-z 12ab", "  lead", "trail  ", "\x00\x1c\x85"]
    fast = tokens.encoder(tokens.vocabulary_path(tokens.RANKS))
    assert fast(texts) == [encode(t) for t in texts]
    assert tokens.encoder(tokens.vocabulary_path())(texts) == [encode(t) for t in texts]


def test_histogram_and_limits(spark, frame, odd, encode):
    lengths = [len(encode(t)) for _, t in odd]
    limits = token_counts.limit_table(token_counts.length_histogram(frame(odd)))
    rows = {r["n_tokens"]: r for r in limits.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["docs_at_most"] == sum(x <= n for x in lengths)
        assert r["total_tokens"] == sum(lengths)
        assert r["kept_tokens"] == sum(min(x, n) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    cuts = {r["context"]: r["kept_tokens"] for r in token_counts.truncated_totals(limits, [0, 1, 7, 1000, 10**6]).collect()}
    assert cuts == {c: sum(min(x, c) for x in lengths) for c in cuts}
    assert token_counts.length_quantile(limits, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]


def test_empty_tables(spark, frame):
    none = frame([])
    assert token_counts.limit_table(token_counts.length_histogram(none)).collect() == []
    assert packing.pack(none).collect() == []
    assert packing.sequences(packing.pack(none)).collect() == []


def test_packing_round_trip(spark, frame, odd, encode):
    pieces = packing.pack(frame(odd).repartition(4), window=64)
    rows = packing.digest(pieces).collect()
    assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 64 for r in rows)
    docs = {}
    for r in rows:
        docs.setdefault((r["sequence_id"] * 64 + r["offset"] - r["start"], r["doc_id"]), []).append(r)
    found = []
    for (_, doc), parts in docs.items():
        parts.sort(key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in parts), "<u4").tolist()
        assert len(ids) == parts[0]["doc_tokens"] and ids[-1] == 0
        found.append((str(doc), ids[:-1]))
    assert sorted(found) == sorted((str(i), encode(t)) for i, t in odd)
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    at = 0
    for sequence, offset, length in spans:  # gapless, and only the last sequence is short
        assert sequence * 64 + offset == at
        at += length
    whole = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert [r["n_ids"] for r in whole[:-1]] == [64] * (len(whole) - 1) and sum(r["n_ids"] for r in whole) == at
    assert all(len(r["ids"]) == 4 * r["n_ids"] for r in whole)


def test_registered_queries(spark, frame, odd, table, encode):
    sf = table(documents=frame(odd))
    rows = QUERIES["op4_packing"](spark, sf)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.agg(F.sum("length")).first()[0] == sum(len(encode(t)) + 1 for _, t in odd)
    assert QUERIES["op10_token_counts"](spark, sf).agg(F.sum("n_docs")).first()[0] == len(odd)


@pytest.mark.parametrize("run", [" " * 1_200_000, "\n" * 1_200_000, "\u3000\t" * 600_000])
def test_long_white_space(encode, run):
    fast = tokens.encoder(tokens.vocabulary_path(tokens.RANKS))
    texts = [run, f"it's{run}b", f"{run}1{run}", f"a {run}\x1c{run[:-1]}\n"]
    assert fast(texts) == [encode(t) for t in texts]


def test_added_tokens_as_the_plain_call_gives_them(spark, frame):
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>  y<|endoftext|><|endoftext|>\n", "<|endoftext| >", "b" + " " * 1_200_000 + "<|endoftext|>" + "\n" * 1_200_000]
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [64, 220, 50256, 275]
    assert tokens.encoder(tokens.vocabulary_path(tokens.RANKS))(texts) == expected
    assert tokens.encoder(tokens.vocabulary_path())(texts) == expected
    found = packing.digest(packing.pack(frame([(1, texts[2])]))).first()
    assert np.frombuffer(bytes(found["ids"]), "<u4").tolist() == [*expected[2], 0] and found["doc_tokens"] == len(expected[2]) + 1
