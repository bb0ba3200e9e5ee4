"""Near-duplicates by min-max hashing of word shingles, every link confirmed on the full sets.

Texts with equal shingle sets form a class (a fingerprint of 128 bits), represented by its smallest
id, so thousands of copies cost one row. Of each representative's set, every permutation keeps both
the minimum and the maximum: half the hash evaluations for as many unbiased values. The values are
banded; BANDS bands of ROWS values miss a pair of similarity 0.8 with probability 1.2e-7.

Candidate pairs are first compared by sketches, the lowest bytes of all values: only pairs whose
estimate is within SLACK (more than five standard deviations at 0.8) of the limit go on to the full
sets, so few sets are shuffled. They are confirmed in two steps. First every member of a bucket
against the bucket's smallest id: that is linear and settles groups of near copies, however large.
Then what shares a bucket but not yet a component. In buckets of up to SMALL members that is all
pairs. Larger ones hold texts that share a template, say, without being near; their members are
joined on rare shingles instead (`prefixes`), which loses no pair above the limit and gives hardly
any below. Pairs within a component needn't be compared. Components come from `_components`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import _shingles
from lakeloom.llm._common import BROADCAST_IDS, join_salted, map_texts, materialize, utf8
from lakeloom.llm._components import components

ROWS, BANDS = 5, 40
#: Members up to which all pairs of a bucket are compared.
SMALL = 16
#: Cells of the sketch that orders shingles by frequency; a full sketch costs time, not links.
CELL_BITS = 20
#: How far a sketch's estimate may be below the limit. The estimate's standard deviation at 0.8 is 0.028.
SLACK = 0.15


def signatures(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, fp (16 bytes) and keys (one per band) of every row."""

    def run(batches):
        for batch in batches:
            sizes, prints, keys = [], [], []
            for _, _, h, off in _shingles.batches_of_sets(batch.column(1), words):
                size = np.diff(off)
                full = np.flatnonzero(size)
                band = np.zeros((len(size), BANDS), np.uint64)
                if len(full):
                    bounds = np.append(off[full], off[-1])  # empty sets take no room
                    band[full] = _shingles.band_keys(_shingles.min_max(h, bounds, ROWS * BANDS // 2), ROWS)
                a, b = _shingles.fingerprints(h, off)
                sizes.append(size)
                prints.append(np.stack([a, b], 1))
                keys.append(band)
            if not sizes:
                continue
            prints, keys = np.concatenate(prints), np.concatenate(keys).view(np.int64)
            fp = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(prints), [None, pa.py_buffer(np.ascontiguousarray(prints))]).cast(pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes).astype(np.int64)), fp, lists], ["id", "n_shingles", "fp", "keys"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return map_texts(rows, run, "id bigint, n_shingles bigint, fp binary, keys array<bigint>")


def sets_of(docs: DataFrame, ids: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp, shingles and sketch of the rows whose id is in ``ids``; texts are shuffled only if the ids are many."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = keep_ids(rows, ids, "id", "left_semi")

    def run(batches):
        for batch in batches:
            at = 0
            for lo, hi, h, off in _shingles.batches_of_sets(batch.column(1), words):
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))
                size = np.diff(off)
                low = np.zeros((len(size), ROWS * BANDS), np.uint8)
                full = np.flatnonzero(size)
                if len(full):
                    low[full] = _shingles.min_max(h, np.append(off[full], off[-1]), ROWS * BANDS // 2).astype(np.uint8)
                prints = np.stack(_shingles.fingerprints(h, off), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, hi - lo), pa.array([x.tobytes() for x in prints], pa.binary()), lists, pa.array([x.tobytes() for x in low], pa.binary())], ["id", "fp", "shingles", "sketch"])
                at += hi - lo

    return map_texts(rows, run, "id bigint, fp binary, shingles array<bigint>, sketch binary")


def keep_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join with a written list of ids, broadcast only if its count allows."""
    ids = ids.select(F.col(ids.columns[0]).alias(key))
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule out the similarity."""
    one = sets.select(F.col("id").alias("a"), F.col("sketch").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
    least = percent / 100 - SLACK

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(utf8(batch.column(i))[0], np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            same = ((x == y).mean(axis=1) - 1 / 256) * 256 / 255 if batch.num_rows else np.zeros(0)
            keep = pa.array(same >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return map_texts(both, run, "a bigint, b bigint")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    pairs = materialize(likely(pairs, sets, percent), "likely")
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles occur, by the cell that their highest bits name: a fixed number of cells."""

    def run(batches):
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_cells(batch.column(0).flatten().to_numpy()), minlength=len(total))
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    cells = sets.select("shingles").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << CELL_BITS, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return out


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """shingle, id, component, n, place and first: the rarest shingles of each set (with its component).

    In one order of all shingles, sets x and y (not larger than y) with the similarity share one
    among the first |y| - ceil(p |y|) + 1 of y and, as both are at least as large as x, among the
    first |x| - ceil(2p |x| / (1 + p)) + 1 of x (marked ``first``). Any order will do; by rarity,
    sets that share common shingles only don't meet.
    """
    shared = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def run(batches):
        for batch in batches:
            ids, components_ = batch.column("id").to_numpy(), batch.column("component").to_numpy()
            lists = batch.column("shingles")
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i in range(batch.num_rows):
                h = flat[off[i] : off[i + 1]]
                n = len(h)
                few = n + (percent * n // -100) + 1
                head = n + (2 * percent * n // -(100 + percent)) + 1
                h = h[np.lexsort((h, shared.value[_cells(h)]))[:few]]
                place = np.arange(1, len(h) + 1)
                same = [pa.array(np.full(len(h), x[i])) for x in (ids, components_)]
                yield pa.RecordBatch.from_arrays([pa.array(h), *same, pa.array(np.full(len(h), n)), pa.array(place), pa.array(place <= head)], ["shingle", "id", "component", "n", "place", "first"])

    rows = sets.select("id", "component", "shingles")
    return map_texts(rows, run, "shingle bigint, id bigint, component bigint, n bigint, place bigint, first boolean")


def rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that share a rare shingle and may have the similarity.

    The place of a pair's first common shingle bounds what they share: none before it, and at most
    the rest of either set after it. Later common shingles give lower bounds still, so the bound
    may be applied to every row.
    """
    rows = materialize(prefixes(sets, percent), "prefixes")
    mixed = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter(F.col("lo") != F.col("hi")).select("shingle")
    rows = materialize(rows.join(mixed, "shingle", "left_semi"), "rare")
    x, y = rows.filter("first").alias("x"), rows.alias("y")
    c = lambda name: F.col(name)
    smaller = (c("x.n") < c("y.n")) | ((c("x.n") == c("y.n")) & (c("x.id") < c("y.id")))
    most = 1 + F.least(c("x.n") - c("x.place"), c("y.n") - c("y.place"))
    enough = (100 + percent) * most >= percent * (c("x.n") + c("y.n"))
    pairs = x.join(y, (c("x.shingle") == c("y.shingle")) & (c("x.component") != c("y.component")) & smaller & enough)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def open_pairs(multi: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs that share a bucket (bucket, id, n) but no component yet and may be near."""
    named = multi.select("bucket", "id", "n").join(parts, "id", "left").withColumn("component", F.coalesce("component", F.col("id")))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter(F.col("lo") != F.col("hi")).select("bucket", (F.col("size") > SMALL).alias("large"))
    named = materialize(named.join(mixed, "bucket"), "mixed")
    some = named.filter(~F.col("large"))
    x, y = some.alias("x"), some.alias("y")
    similar = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")  # else the sets can't be near
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component")) & similar)
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    large = materialize(named.filter("large").select("id", "component").distinct(), "large")
    if large.limit(1).count():
        of_large = materialize(sets.join(large, "id"), "largesets")
        pairs = pairs.unionAll(rare_pairs(of_large, percent))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, component_id (smallest key reachable) and kept of every row.

    A set holds the distinct shingles of ``words`` words (white-space runs separate, A-Z are
    lower-cased); fewer words are one shingle, no words none. Texts without words are linked with
    nothing. Rows of one key are one document: linked, also where their texts differ. A null key is
    alone: component_id null, kept. Similarity is the sets' intersection by their union, at least
    ``percent`` / 100.
    """
    base = materialize(signatures(docs, words, key, text), "signatures")
    full = base.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    # repeated rows and copies go in the partial aggregation
    classes = materialize(full.groupBy("fp").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    twice = materialize(full.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter(F.col("lo") != F.col("hi")).select("id"), "twice")
    given = keep_ids(full.select("id", "fp"), twice, "id", "left_semi").distinct().join(classes.select("fp", "rep"), "fp")
    lowest = given.groupBy("id").agg(F.min("rep").alias("b"))
    given = given.join(lowest, "id").select(F.col("rep").alias("a"), "b").filter(F.col("a") != F.col("b"))

    # band buckets of representatives
    members = classes.select(F.col("rep").alias("id"), "n", F.explode("keys").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("_last")).filter(F.col("first") != F.col("_last")).drop("_last")
    multi = materialize(members.join(buckets, "bucket"), "buckets")
    candidates = materialize(multi.select("id").distinct(), "candidates")
    sets = materialize(sets_of(docs, candidates, words, key, text).dropDuplicates(["id", "fp"]), "sets")

    stars = multi.filter(F.col("id") != F.col("first")).select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    links = materialize(confirm(stars, sets, percent).unionAll(given), "confirmed")
    parts = materialize(components(links), "parts")

    compared = stars.select(F.col("b").alias("a"), F.col("a").alias("b"))  # the smaller id first
    more = materialize(confirm(open_pairs(multi, parts, sets, percent).join(compared, ["a", "b"], "left_anti"), sets, percent), "confirmed")
    parts = materialize(components(links.unionAll(more)), "parts")

    roots = classes.select("fp", "rep").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", F.col("rep")).alias("component_id"))
    slim = base.select(F.col("id").alias(key), "n_shingles", "fp")
    linked = join_salted(materialize(slim.filter((F.col("n_shingles") > 0) & F.col(key).isNotNull()), "linked"), roots, "fp", key, "inner")
    alone = slim.filter((F.col("n_shingles") == 0) | F.col(key).isNull()).withColumn("component_id", F.col(key))
    out = linked.select(key, "n_shingles", "component_id").unionAll(alone.select(key, "n_shingles", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each group, all columns.

    If keys repeat among the kept rows, one row of each key stays. Rows with a null key all stay.
    """
    found = near_duplicates(docs, words, percent, key, text).filter(F.col(key).isNotNull())
    found = materialize(found.select(key, "kept"), "kept")
    dropped = materialize(found.filter(~F.col("kept")).select(key).distinct(), "dropped")
    rows = keep_ids(docs, dropped, key, "left_anti")
    kept = found.filter("kept")
    repeated = kept.groupBy(key).count().filter("count > 1").limit(1).count()
    if not repeated:
        return rows
    return rows.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionAll(rows.filter(F.col(key).isNull()))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) END AS g
  FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
f AS (SELECT DISTINCT md5(string_agg(x, chr(10) ORDER BY x)) AS h, doc_id, min(n) AS n FROM e GROUP BY doc_id),
c AS (SELECT h, min(doc_id) AS rep FROM f GROUP BY h),
r AS (SELECT e.* FROM e JOIN c ON e.doc_id = c.rep),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS id, rep AS root FROM c UNION SELECT p.b, reach.root FROM reach JOIN p ON p.a = reach.id),
k AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
m AS (SELECT f.doc_id, k.root FROM f JOIN c ON f.h = c.h JOIN k ON k.id = c.rep)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, coalesce(m.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN m ON s.doc_id = m.doc_id
"""
