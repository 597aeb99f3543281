"""Near-duplicate classes of documents: fast similarity sketches, banding, exact verification.

Sketch: Dahlgaard, Knudsen, Thorup, Fast Similarity Sketching (FOCS 2017). In round i every element gets a bin and a value in [i, i + 1), each bin keeps its least value, and rounds stop when all bins are filled; from round t on, each round fills one fixed bin with all elements, so every coordinate is filled after 2t rounds at most.

Steps, none of which emits all pairs of a group:
1. documents with the same set of shingles collapse to their smallest doc_id;
2. the others' sketches are cut into bands; in a bucket (equal band) each member is paired with the bucket's smallest member, and each document's smallest such partner is verified on the full sets: a forest whose components are classes so far;
3. in buckets that still hold several classes, members of all classes but the largest are paired with one member of the largest, and classes merge;
4. the documents of buckets that still hold several classes are joined by prefix filter (Chaudhuri, Ganti, Kaushik, A Primitive Operator for Similarity Joins, 2006): two sets with J >= 0.8 share one of the n - ceil(0.8 n) + 1 first elements of each, in any order common to all; the order puts rare elements first (counted exactly over these documents), so that what a whole family shares meets nowhere, and an element of one document only takes a place but meets nothing. Groups of more than GROUP documents are cut into a grid of blocks. Only pairs of different classes come out, and pairs whose sketches agree enough are verified. With that every pair of a bucket has been verified, lies in one class or can't be a link.
Where many pairs to verify share a document (the smallest of a large family), its text goes to each FAN of them separately: no key is hot.
With 40 bands of 5 rows a pair at the limit of 0.8 shares no bucket with a chance of 1e-7.

Nulls: a null text is empty; a null doc_id is linked with nothing and kept. Documents without words have no shingles, are linked with nothing and kept. Rows that repeat a doc_id with the same text get the same result each; those with different texts are classed each by its own text (a row is kept if its doc_id is the smallest of its class). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
#: A pair with J = 0.8 has 160 equal coordinates of 200; 0.66 is five standard deviations below.
SKETCH_LEAST = 0.66
#: Pairs to verify that take one copy of the text they share, and documents that meet in one block of a group.
FAN, GROUP = 256, 2000
#: Ids broadcast at once: 16 MB at most.
BROADCAST_IDS = 1_000_000

_SEEDS = C.mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64(10)


def sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t coordinates (uint64: the round in the top bits, then the value) of a non-empty set of 64-bit elements."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    n, i = len(elements), 0
    while i < t and (not i or out.max() == np.iinfo(np.uint64).max):
        rounds = min(t - i, max(1, 3 * t // n))
        v = C.mix(elements[None, :] ^ _SEEDS[i : i + rounds, None])
        bins = (C.mix(v) % np.uint64(t)).astype(np.int64)
        np.minimum.at(out, bins.ravel(), ((np.arange(i, i + rounds, dtype=np.uint64) << np.uint64(54))[:, None] | (v >> _LOW)).ravel())
        i += rounds
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[b] = (np.uint64(t + b) << np.uint64(54)) | (C.mix(elements ^ _SEEDS[t + b]) >> _LOW).min()
    return out


def bands_of(coordinates: np.ndarray) -> np.ndarray:
    x = np.arange(BANDS, dtype=np.uint64)
    for column in coordinates.reshape(BANDS, ROWS).T:
        x = C.mix(x * np.uint64(0x9E3779B97F4A7C15) + column)
    return x.view(np.int64)


def _sketches(k: int):
    def run(batches):
        for batch in batches:
            ids, n, keys, coords, bands = batch.column(0), [], [], [], []
            for data in batch.column(1).to_pylist():
                s = C.shingles(C.words_of(data), k)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    c = sketch(s)
                    coords.append(c.astype(np.uint32).tobytes())
                    bands.append(bands_of(c))
                else:
                    coords.append(b"")
                    bands.append([])
            yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(coords, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "coords", "bands"])

    return run


def _agree(batches):
    """Equal coordinates of two sketches, as a fraction."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, COORDINATES) for i in (2, 3))
        keep = pa.array((x == y).mean(axis=1) >= SKETCH_LEAST)
        yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)


def _verify(k: int, percent: int):
    def run(batches):
        seen = (None, None)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if seen[0] != x:
                    seen = (x, C.shingles(C.words_of(x), k))
                s, r = seen[1], C.shingles(C.words_of(y), k)
                common = 0
                if 100 * min(len(s), len(r)) >= percent * max(len(s), len(r)):
                    at = np.searchsorted(s, r)
                    at[at == len(s)] = 0
                    common = int((s[at] == r).sum()) if len(s) else 0
                keep.append(common > 0 and 100 * common >= percent * (len(s) + len(r) - common))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tokens(k: int):
    """The shingles of each text."""

    def run(batches):
        for batch in batches:
            sets = [C.shingles(C.words_of(data), k) for data in batch.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            ids = np.repeat(batch.column("doc_id").to_numpy(), sizes)
            for i in range(0, len(flat), 1 << 16):
                yield pa.record_batch([pa.array(x[i : i + (1 << 16)]) for x in (flat, ids, np.repeat(sizes, sizes))], ["token", "rep", "n"])

    return run


def prefixes(texts: DataFrame, scratch: C.Scratch, k: int, percent: int) -> DataFrame:
    """token, rep, n (size of the set), place: of the first elements of each set, rarest first, those that another set has too."""
    tokens = scratch.write(texts.mapInArrow(C.lean("minhash", _tokens(k)), "token long, rep long, n long"), "tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    sets = tokens.join(common, "token").groupBy("rep").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))  # a text's shingles
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    alone = F.col("n") - F.size("shared")
    heads = sets.select("rep", "n", alone.alias("alone"), F.slice("shared", F.lit(1), F.greatest(F.lit(0), first - alone).cast("int")).alias("head")).select("rep", "n", "alone", F.posexplode("head").alias("at", "x"))
    return scratch.write(heads.select(F.col("x.token").alias("token"), "rep", "n", (F.col("alone") + F.col("at")).alias("place")), "heads")


def grid(rows: DataFrame, wide: DataFrame, member: str, own: str, other: str) -> DataFrame:
    """Rows of groups (token) with the block of the member, once for each block of the other side. wide: token, blocks, of large groups."""
    out = rows.join(wide, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return out.withColumn(own, F.pmod(F.xxhash64(member), F.col("blocks"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")


def merged(classes: DataFrame, links: DataFrame, scratch: C.Scratch) -> DataFrame:
    """classes (node, component) after links (a, b) between nodes, both tables already written."""
    over = lambda c: classes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class"))
    edges = links.join(over("a"), "a", "left").join(over("b"), "b", "left").select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b"))
    joined = scratch.write(C.connected_components(edges, scratch).select(F.col("node").alias("class"), F.col("component").alias("into")), "joined")
    old = classes.join(joined, classes.component == joined["class"], "left").select("node", F.coalesce("into", "component").alias("component"))
    new = joined.join(classes, joined["class"] == classes.node, "left_anti").select(F.col("class").alias("node"), F.col("into").alias("component"))
    return scratch.write(old.unionAll(new), "classes")


def split_groups(members: DataFrame, classes: DataFrame, scratch: C.Scratch, by: str) -> DataFrame:
    """Of members (by, rep, ...) those of groups with several classes, with class and main, the group's largest class."""
    named = members.join(classes, members.rep == classes.node, "left").drop("node").withColumn("class", F.coalesce("component", "rep")).drop("component")
    mixed = named.groupBy(by, "class").agg(F.count("*").alias("size")).groupBy(by).agg(F.max(F.struct("size", "class")).alias("most"), F.count("*").alias("classes")).where("classes > 1").select(by, F.col("most.class").alias("main"))
    return scratch.write(named.join(scratch.write(mixed, "mixed"), by), "named")


def agreeing(pairs: DataFrame, each: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Of pairs (a, b), a table already written, those whose sketches agree in enough coordinates."""
    need = scratch.write(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct(), "need")
    coords = scratch.write(each.select("doc_id", "coords").where("length(coords) > 0").join(C.broadcast_below(need, BROADCAST_IDS), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "coords")
    x, y = (coords.select(F.col("doc_id").alias(c), F.col("coords").alias(f"{c}_coords")) for c in "ab")
    return scratch.write(pairs.join(x, "a").join(y, "b").select("a", "b", "a_coords", "b_coords").mapInArrow(_agree, "a long, b long"), "near")


def verified(pairs: DataFrame, docs: DataFrame, scratch: C.Scratch, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of doc_ids, a table already written, those whose whole texts have enough shingles in common."""
    need = scratch.write(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct(), "need")
    texts = scratch.write(docs.join(C.broadcast_below(need, BROADCAST_IDS), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    fans = scratch.write(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("fans")).where("fans > 1"), "fans")
    fans = C.broadcast_below(fans, BROADCAST_IDS)
    one = F.coalesce("fans", F.lit(1).cast("long"))
    dealt = pairs.join(fans, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), one).alias("fan"))
    x = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")).join(fans, "a", "left").select("a", "a_text", F.explode(F.sequence(F.lit(0).cast("long"), one - 1)).alias("fan"))
    y = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    return scratch.write(dealt.join(y, "b").join(x, ["a", "fan"]).select("a", "b", "a_text", "b_text").mapInArrow(C.lean("minhash", _verify(k, percent)), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles (distinct), component_id (smallest doc_id reachable over links, itself included), kept (doc_id = component_id).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of shingle-word shingles.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    scratch = C.Scratch(spark, "minhash")
    docs = C.id_and_text(docs, key, text)
    each = sketched(docs, scratch, shingle)
    several = each.where("doc_id is not null").select("doc_id", F.xxhash64("set_key").alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b")
    if several.isEmpty():
        return classed(docs, each, scratch, shingle, percent)
    rows = scratch.write(docs.withColumn("row", F.monotonically_increasing_id()), "rows")  # ids don't tell texts apart: numbers of a written table do
    numbered = rows.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text")
    found = classed(numbered, sketched(numbered, scratch, shingle), scratch, shingle, percent).withColumnsRenamed({"doc_id": "row", "component_id": "class"}).drop("kept")
    found = scratch.write(found.join(rows.select("row", "doc_id"), "row"), "found")
    least = found.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    out = found.join(least, "class").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.unionAll(each.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def sketched(docs: DataFrame, scratch: C.Scratch, shingle: int) -> DataFrame:
    return scratch.write(docs.mapInArrow(C.lean("minhash", _sketches(shingle)), "doc_id long, n_shingles long, set_key binary, coords binary, bands array<long>"), "sketches")


def classed(docs: DataFrame, each: DataFrame, scratch: C.Scratch, shingle: int, percent: int) -> DataFrame:
    """near_duplicates() where a doc_id has one text."""
    sets = scratch.write(each.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "sets")
    reps = each.where("n_shingles > 0").join(sets.select(F.col("set_key").alias("of"), "rep"), (F.col("set_key") == F.col("of")) & (F.col("doc_id") == F.col("rep")), "left_semi").dropDuplicates(["set_key"])
    rows = scratch.write(reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band")), "bands")
    buckets = rows.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least")
    members = scratch.write(rows.join(scratch.write(buckets, "buckets"), "band").select("band", "least", "rep"), "members")
    forest = scratch.write(members.where("rep <> least").groupBy("rep").agg(F.min("least").alias("a")).select("a", F.col("rep").alias("b")), "forest")
    classes = scratch.write(C.connected_components(verified(forest, docs, scratch, shingle, percent), scratch), "classes")

    members = members.select("band", "rep")
    named = split_groups(members, classes, scratch, "band")
    if not named.isEmpty():
        pivots = named.where("class = main").groupBy("band").agg(F.max("rep").alias("pivot"))
        pairs = named.where("class <> main").join(pivots, "band").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        near = agreeing(scratch.write(pairs, "pairs"), each, scratch)
        classes = merged(classes, verified(near, docs, scratch, shingle, percent), scratch)
        named = split_groups(named.select("band", "rep"), classes, scratch, "band")
    if not named.isEmpty():
        some = scratch.write(named.select(F.col("rep").alias("doc_id")).distinct(), "some")
        texts = scratch.write(docs.join(C.broadcast_below(some, BROADCAST_IDS), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
        heads = prefixes(texts, scratch, shingle, percent)
        named = split_groups(heads, classes, scratch, "token")
        rest = named.where("class <> main").select("token", F.col("rep").alias("x"), F.col("class").alias("of_x"), F.col("n").alias("n_x"), F.col("place").alias("place_x"))
        # from a first common element on, both sets must hold enough elements (the positional filter of Xiao et al., Efficient Similarity Joins, 2008)
        fits = f"class <> of_x and (class = main or rep < x) and {100 + percent} * least(n - place, n_x - place_x) >= {percent} * (n + n_x)"
        wide = scratch.write(named.groupBy("token").agg(F.ceil(F.count("*") / GROUP).alias("blocks")).where("blocks > 1"), "wide")
        wide = C.broadcast_below(wide, BROADCAST_IDS)
        pairs = grid(named, wide, "rep", "block", "block_x").join(grid(rest, wide, "x", "block_x", "block"), ["token", "block", "block_x"]).where(fits).select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b")).distinct()
        near = agreeing(scratch.write(pairs, "pairs"), each, scratch)
        classes = merged(classes, verified(near, docs, scratch, shingle, percent), scratch)

    sets = sets.join(classes, sets.rep == classes.node, "left").select(F.col("set_key").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    out = each.select("doc_id", "n_shingles", "set_key").join(sets, F.col("set_key") == F.col("of"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
