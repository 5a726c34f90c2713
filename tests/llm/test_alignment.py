"""Token alignment against a brute force that follows the definition, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tillgrid.llm import alignment
from tillgrid.llm.queries import QUERIES
from tillgrid.llm.tokens import RANKS, VOCABULARY, vocabulary_path


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(alignment.PIECES))


def token_bytes(coders, a_ids, b_ids):
    a, b = coders
    letters = {c: i for i, c in enumerate([chr(x) for x in [*range(33, 127), *range(161, 173), *range(174, 256)]])}
    order = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in order} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in order)}
    assert set(letters) <= set(table)
    left = [bytes(table[c] for c in a.id_to_token(i)) for i in a_ids]
    right = [bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in b_ids]
    return left, right


def brute(coders, rows):
    docs = []
    for i, text in rows:
        if not text:
            docs.append((i, [], [], []))
            continue
        a_ids = coders[0].encode(" " + text, add_special_tokens=False).ids
        b_ids = coders[1].encode(text)
        left, right = token_bytes(coders, a_ids, b_ids)
        if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            docs.append((i, [], [], []))
            continue
        groups, ga, gb, x, y, p, q = [], [], [], 0, 0, 0, 0
        while p < len(left) or q < len(right):
            if x <= y:
                x += len(left[p])
                ga.append(a_ids[p])
                p += 1
            else:
                y += len(right[q])
                gb.append(b_ids[q])
                q += 1
            if x == y:
                groups.append((ga, gb))
                ga, gb = [], []
        docs.append((i, a_ids, b_ids, groups))
    count = Counter()
    links = []
    for _, _, _, groups in docs:
        own = Counter()
        for ga, gb in groups:
            for (u, n), (v, m) in ((s, t) for s in Counter(ga).items() for t in Counter(gb).items()):
                own[u, v] += n * m
        links.append(own)
        count.update(own.keys())
    highest = defaultdict(int)
    for (u, _), n in count.items():
        highest[u] = max(highest[u], n)
    out = []
    for (i, a_ids, b_ids, groups), own in zip(docs, links):
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((str(i), len(a_ids), len(b_ids), len(groups), sum(own.values()), sum(n for (u, v), n in own.items() if count[u, v] == highest[u]),
                    sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if a_ids else ""))
    return sorted(out), {p: (n, sum(own[p] for own in links)) for p, n in count.items()}


def texts(odd):
    rng = random.Random(1)
    words = ["the", "of", "überaus", "naïve", "token", "tokenizers", "Straße", "x1y2", "don't", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", "日本", "\U0001f600", "1234567", "https://a.b/c?d=e"]
    rows = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    return rows + odd + [(1, "  two  spaces "), (2, "\ttab\nline\r\n"), (3, "a\u0000b"), (4, "Ａﬁ  "), (5, " "), (6, "the the the the"), (6, "the the the the"), (7, "q" * 3000 + " " * 5000)]


def found(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


def test_matches_brute_force(spark, frame, odd, table, coders):
    rows = texts(odd)
    expected, _ = brute(coders, rows)
    df = QUERIES["op11_alignment"](spark, table(documents=frame(rows).repartition(3)))
    assert found(df) == expected
    assert sum(r[4] for r in expected) > 2000


def test_several_containers(spark, frame, coders):
    rng = random.Random(8)
    words = ["the", "of", "token", "überaus", "x1y2", "a", "an"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5)))) for i in range(2 * alignment.CONTAINER + 300)]
    expected, _ = brute(coders, rows)
    assert found(alignment.align(frame(rows).coalesce(1))) == expected


def test_small_blocks(spark, frame, odd, coders, monkeypatch):
    """Groups counted by ids, and blocks of few links, give the same links."""
    rows = texts(odd)
    a, b = alignment.byte_tokens(vocabulary_path(RANKS)), alignment.piece_tokens(vocabulary_path(alignment.PIECES))
    whole = alignment.Batch([t for _, t in rows], a, b)
    slots = np.arange(len(rows))
    expected = alignment.summed(*map(np.concatenate, zip(*whole.links(slots, len(b.entries)))))
    monkeypatch.setattr(alignment, "EXPANDED", 50)
    monkeypatch.setattr(alignment, "LARGE", 10)
    again = alignment.summed(*map(np.concatenate, zip(*whole.links(slots, len(b.entries)))))
    assert all(np.array_equal(x, y) for x, y in zip(expected, again)) and expected[1].max() > 100


def test_pair_counts(spark, frame, odd, coders):
    rows = texts(odd)
    _, expected = brute(coders, rows)
    held = alignment.index(frame(rows).repartition(2))
    n_b = coders[1].get_piece_size()
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in alignment.pair_counts(held, n_b).collect()} == expected


def test_json_and_ranks_give_the_same_tokens(odd):
    fast, slow = alignment.byte_tokens(vocabulary_path(RANKS)), alignment.byte_tokens(vocabulary_path(VOCABULARY))
    shown = [" " + (t or "") for _, t in texts(odd)]
    assert fast.encode(shown) == slow.encode(shown)
    assert fast.entries == slow.entries[: len(fast.entries)]


def test_bitmaps():
    rng = np.random.default_rng(2)
    bits, most = alignment.BITS, alignment.CONTAINER
    keys = np.unique(np.concatenate([7 << bits | rng.integers(0, most, most // 2), 9 << bits | rng.integers(0, most, 40), 8 << bits | np.arange(most)]))
    links = rng.integers(1, 3000, len(keys))
    own = alignment.Index.load(alignment.Index.pack(keys, links).dump())
    group, place, n = own.unpack()
    assert np.array_equal(own.pairs[group] << bits | place, keys) and np.array_equal(n, links)
    docs, total = own.counts()
    assert docs.tolist() == [int((keys >> bits == p).sum()) for p in own.pairs] and total.tolist() == [int(links[keys >> bits == p].sum()) for p in own.pairs]
    parts = [alignment.Index.pack(keys[i::3], links[i::3]) for i in range(3)] + [alignment.Index.pack(keys[:50], links[:50])]
    merged = alignment.Index.merge(parts)
    group, place, n = merged.unpack()
    assert np.array_equal(merged.pairs[group] << bits | place, keys) and np.array_equal(n, links + np.where(np.arange(len(keys)) < 50, links, 0))


def test_empty(spark, frame, table):
    for rows in ([], [(1, None), (2, ""), (None, None)]):
        df = QUERIES["op11_alignment"](spark, table(documents=frame(rows)))
        assert found(df) == sorted((str(i), 0, 0, 0, 0, 0, 0, "") for i, _ in rows)
