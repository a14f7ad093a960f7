"""Merge-path alignment against plain Python: the tokenizers' own output, offset sets and all pairs."""

import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatlens.llm import queries, token_alignment
from tests.llm.conftest import messy_rows

FILES = P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model")


def byte_characters():
    """The byte-level alphabet, from its definition: bytes that print stand for themselves."""
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(FILES[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
        self.byte = byte_characters()

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in a.ids]
        right = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if not text or any(b"".join(b for _, b in side) != whole for side in (left, right)):
            return [], []
        return left, right

    @staticmethod
    def ends(tokens):
        out, at = [], 0
        for i, b in tokens:
            at += len(b)
            out.append((i, at))
        return out

    def groups(self, text):
        a, b = map(self.ends, self.tokens(text))
        common = sorted({e for _, e in a} & {e for _, e in b})
        out = [([], []) for _ in common]
        for side, tokens in enumerate((a, b)):
            for i, e in tokens:
                out[bisect.bisect_left(common, e)][side].append(i)
        return len(a), len(b), out

    def documents(self, rows):
        found = [(i, *self.groups(t or "")) for i, t in rows]
        count = Counter()
        for *_, groups in found:
            count.update({(x, y) for a, b in groups for x in a for y in b})
        most = defaultdict(int)
        for (x, _), n in count.items():
            most[x] = max(most[x], n)
        out = []
        for i, n_a, n_b, groups in found:
            links = [(x, y) for a, b in groups for x in a for y in b]
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            out.append((i, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                        hashlib.sha256(text.encode()).hexdigest() if groups else ""))
        return sorted(out, key=repr), count, most


@pytest.fixture(scope="module")
def brute():
    return Brute()


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def got(df, digest=True):
    return sorted((tuple(r[c] for c in (*COLUMNS, "groups")) for r in token_alignment.Alignment(df, *FILES, digest=digest).documents().collect()), key=repr)


ODD = ["▁ a", "<s> </s> <unk> <|endoftext|>", "  two  spaces ", "  　", "​﻿\u0085 ", "é" * 300, "ab" * 700 + " x",
       "日本語のテキスト" * 40, "\x00", "'LL 'll 12345 ½", "\r\n\t", "same text", "same text", "🤗🏳️‍🌈" * 20]


def test_messy_and_odd_texts(spark, messy, no_rows, brute):
    rows = [(r[0], r[1]) for r in messy_rows() if r[0] != 4]  # the longest has a test of its own
    assert got(messy.filter("NOT doc_id <=> 4")) == brute.documents(rows)[0]
    odd = spark.createDataFrame([*enumerate(ODD), (0, None)], "doc_id long, text string")
    assert got(odd) == brute.documents([*enumerate(ODD), (0, None)])[0]
    assert got(no_rows) == []


def test_small_pieces_blocks_and_link_steps_change_nothing(spark, brute, monkeypatch):
    rows = [*enumerate(ODD), *((100 + i, f"word{i % 7} and the other words, {i} times; naïve Übergröße" * (i % 5)) for i in range(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.documents(rows)[0]
    both = []
    for small in (False, True):
        sides, out = token_alignment.tokenizers_of(*FILES), []
        if small:
            monkeypatch.setattr(token_alignment, "BYTES", 100)
            for name, n in (("common_ends", 3), ("link_counts", 2)):
                old = getattr(token_alignment, name)
                monkeypatch.setattr(token_alignment, name, lambda *a, f=old, n=n: f(*a, n))
        for k in range(0, len(rows), 9 if small else 1000):
            part = rows[k:k + (9 if small else 1000)]
            ids, texts = pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part])
            block = token_alignment._block(ids, texts, k, *sides, True).to_pylist()
            pairs = block[-1]["pair"]
            out += [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"],
                     sorted((pairs[i], n) for i, n in zip(r["at"], r["times"]))) for r in block[:-1]]
        both.append(out)
    assert both[0] == both[1]
    assert sorted(((*r[:5], r[5]) for r in both[0]), key=repr) == sorted(((*r[:5], r[7]) for r in want), key=repr)
    assert got(df) == want


def test_pairs_and_group_texts(spark, brute):
    rows = [(1, "tokenizers align"), (2, "tokenizers align twice, tokenizers"), (3, None)]
    aligned = token_alignment.Alignment(spark.createDataFrame(rows, "doc_id long, text string"), *FILES)
    _, count, most = brute.documents(rows)
    assert {(r["a_id"], r["b_id"]): (r["n_docs"], r["is_best"]) for r in aligned.pairs().collect()} == {
        p: (n, n == most[p[0]]) for p, n in count.items()}
    texts = {r["doc_id"]: r["groups"] for r in aligned.documents().collect()}
    assert texts == {i: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute.groups(t or "")[2]) for i, t in rows}


def test_query_equals_brute_force(spark, brute):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op12_token_alignment(spark, "/root/testdata/sf0.001")
    assert df.columns == [*COLUMNS, "groups_sha256"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == brute.documents(rows)[0]


def test_a_long_text(spark, messy, brute):
    text = next(r[1] for r in messy_rows() if r[0] == 4)
    a, b = map(brute.ends, brute.tokens(text))
    (row,) = token_alignment.Alignment(messy.filter("doc_id = 4"), *FILES).documents().collect()
    assert (row["n_a"], row["n_b"], row["n_groups"]) == (len(a), len(b), len({e for _, e in a} & {e for _, e in b}))


rising = st.lists(st.integers(1, 9), min_size=0, max_size=60).map(lambda x: np.cumsum(np.array(x, np.int64)).astype(np.int64))


@settings(deadline=None, max_examples=300)
@given(rising, rising, st.integers(1, 12))
def test_pieces_cover_the_merge_evenly(a, b, piece):
    i, j = token_alignment.diagonals(a, b, piece)
    assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and (i[-1], j[-1]) == (len(a), len(b))
    assert all(0 <= (i[k + 1] + j[k + 1]) - (i[k] + j[k]) <= piece + 1 for k in range(len(i) - 1))
    cut_a, cut_b = token_alignment.common_ends(a, b, piece)
    assert a[cut_a - 1].tolist() == b[cut_b - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
