"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into 23 + 23 + 15 + 3, and the anchors are the words
whose parts lie in the binary Golay code, the Golay code, the Hamming code and
the repetition code. All four are perfect with radius 3, 3, 1 and 1, so every
fingerprint has one *home* anchor. If two fingerprints differ in at most ``t``
bits, the bits by which the second must change to share the first's home
are at most ``t``: in each part, the distance to the anchor beyond the
part's radius. So each fingerprint *visits* every anchor whose distances exceed
the radii by ``t`` in all, and each pair meets at the home of its smaller member,
exactly once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

#: Shingle hashes counted at a time.
FLUSH = 1 << 17
#: (bits, generator of the cyclic code, radius) of each part: x^11+x^9+x^7+x^6+x^5+x+1, x^4+x+1, x^2+x+1.
PARTS = ((23, 0b101011100011, 3), (23, 0b101011100011, 3), (15, 0b10011, 1), (3, 0b111, 1))


def fingerprints(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp) for (doc_id, text): bit set if it is set in over half of the shingles' XXH64."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        n = batch.num_rows
        ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
        buffer, owners, starts = [], [], []

        def flush():
            if buffer:
                bits = np.unpackbits(np.array(buffer, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
                np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
                buffer.clear(), owners.clear(), starts.clear()

        for i, text in enumerate(batch.column(1).cast(pa.binary())):
            words = (text.as_py() or b"").lower().split()
            if not words:
                continue
            if len(words) < shingle:
                shingles: Iterable = [words]
                total[i] = 1
            else:
                shingles = zip(*(words[k:] for k in range(shingle)))
                total[i] = len(words) - shingle + 1
            while part := list(itertools.islice(shingles := iter(shingles), FLUSH)):
                owners.append(i), starts.append(len(buffer))
                buffer += [digest(b" ".join(s), 42) for s in part]
                if len(buffer) >= FLUSH:
                    flush()
        flush()
        packed = np.packbits(2 * ones > total[:, None], axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(packed.reshape(-1).view(">i8").astype(np.int64))], ["doc_id", "fp"])


def _remainder(words: np.ndarray, bits: int, generator: int) -> np.ndarray:
    """Syndrome of each word: its remainder by the generator polynomial."""
    out, degree = words.copy(), generator.bit_length() - 1
    for k in range(bits - 1, degree - 1, -1):
        out ^= np.where(out >> k & 1, generator << (k - degree), 0)
    return out


def _covers(bits: int, generator: int, radius: int, threshold: int) -> list[np.ndarray]:
    """For each excess 0..threshold: a table (syndrome, k) of the differences
    that lead to an anchor at that excess, -1 where there are fewer."""
    found: list[dict[int, list[int]]] = [{} for _ in range(threshold + 1)]
    for weight in range(min(bits, radius + threshold) + 1):
        vectors = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(bits), weight)], np.int64)
        for s, v in zip(_remainder(vectors, bits, generator), vectors):
            found[max(0, weight - radius)].setdefault(int(s), []).append(int(v))
    tables = []
    for of in found:
        table = np.full((1 << generator.bit_length() - 1, max(map(len, of.values()), default=0)), -1, np.int64)
        for s, vs in of.items():
            table[s, : len(vs)] = vs
        tables.append(table)
    return tables


class Covering:
    """Anchors of fingerprints; parts as in ``PARTS``."""

    def __init__(self, threshold: int, parts=PARTS):
        if sum(p[0] for p in parts) != 64:
            raise ValueError("the parts must have 64 bits in all")
        self.threshold, self.parts = threshold, parts
        kinds = {p: _covers(*p, threshold) for p in set(parts)}
        self.tables = [kinds[p] for p in parts]

    def anchors(self, fps: np.ndarray, threshold: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(anchor, fingerprint) pairs, for one choice of differences after another."""
        threshold = self.threshold if threshold is None else threshold
        shift, per_part = 0, []
        for (bits, generator, _), tables in zip(self.parts, self.tables):
            syndrome = _remainder((fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64), bits, generator)
            per_part.append([[(t[syndrome, k], np.uint64(shift)) for k in range(t.shape[1])] for t in tables])
            shift += bits
        for excess in itertools.product(range(threshold + 1), repeat=len(self.parts)):
            if sum(excess) > threshold:
                continue
            for chosen in itertools.product(*(p[e] for p, e in zip(per_part, excess))):
                ok = np.ones(len(fps), bool)
                for v, _ in chosen:
                    ok &= v >= 0
                if ok.any():
                    anchor = fps[ok]
                    for v, at in chosen:
                        anchor = anchor ^ (v[ok].astype(np.uint64) << at)
                    yield anchor, fps[ok]


def _deal(threshold: int, home: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covering = Covering(threshold)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for anchor, fp in covering.anchors(fps, 0 if home else threshold):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp.view(np.int64))], ["anchor", "fp"])
    return run


def links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Pairs ``(a, b)`` of distinct ``fp`` in ``nodes`` that differ in at most ``max_bits`` bits."""
    schema = "anchor long, fp long"
    # the rows are few and each makes many: dealt out evenly, whatever files they lie in
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    home = nodes.select("fp").mapInArrow(_deal(max_bits, True), schema).select("anchor", F.col("fp").alias("a"))
    visit = nodes.select("fp").mapInArrow(_deal(max_bits, False), schema).select("anchor", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return visit.join(home, (home["anchor"] == visit["anchor"]) & (F.col("a") < F.col("b")) & near).select("a", "b")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id, n_links`` for every row of ``docs``.

    Words are split at ASCII white space after A-Z are lower-cased; a text of
    fewer words than ``shingle`` is one shingle, one of none (empty, null) has
    fingerprint zero, linked like any other. ``component_id`` is the smallest id
    reachable over links of at most ``max_bits`` bits; ``n_links`` counts the
    other distinct fingerprints linked directly. Repeated rows and ids stay
    rows of their own. A null id joins its component; where all ids of a
    component are null, so is ``component_id``. Other columns are ignored.

    Copies are one node: rows are grouped by fingerprint before any search,
    and a fingerprint has at most 2,080 others within two bits, so a large group
    of near copies gives a number of links in proportion to its fingerprints.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fps = stored(rows.mapInArrow(lambda b: fingerprints(b, shingle), "doc_id long, fp long"), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    edges = stored(links(nodes, max_bits), "links")
    roots = connected_components(edges)
    degree = (edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node")
              .agg(F.count("*").alias("n_links")))
    member = (nodes.join(roots, nodes["fp"] == roots["node"], "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lows = member.groupBy("root").agg(F.min("low").alias("component_id"))
    of = (member.join(lows, "root").join(degree, F.col("fp") == degree["node"], "left")
          .select("fp", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    return fps.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its component.

    Rows with a null id stay: nothing can be said to stand for them. Rows that repeat
    the smallest id all stay, since the id names one document.
    """
    key = "__component_key"
    first = (simhash_components(docs, id_col, text_col, shingle, max_bits)
             .filter("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct())
    return docs.join(first, docs[id_col] == first[key], "left_anti")
