"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles (64-bit hashes of lower-cased words). Two sets
can only reach the threshold if their prefixes, the first ``n - ceil(t n) + 1`` shingles in one
global order, share a shingle. The order puts shingles that are frequent in a bounded sample last;
it decides how many candidates there are, never which pairs are found.

Documents with equal sets are one class; classes with the same size and prefix are one group, and
only groups are posted under the shingles of their prefix. Posting lists of one group are dropped,
the others are expanded to classes. Candidates must agree in size and in a parity bitmap of their
sets (the bits in which two bitmaps differ are a lower bound of the set difference, so no link is
lost), and are then verified on the whole texts.

A posting list of m classes is not turned into its m * m pairs. Lists of up to ``SHORT`` classes are
paired as they are. Longer ones are compared in blocks of ``BLOCK`` classes, a block with a block in a
task, and a task puts out a spanning forest of the pairs that pass, nearest first: a pair between
classes that are connected already adds nothing if those links hold. After they have been verified, a
second look at the long lists puts out every pair that passes, was not tested and is still not
connected. So every pair of a list is either tested or connected, and components are exact.

Defined results: null, empty and blank texts have no shingle and are linked with nothing; texts of
fewer words than a shingle are one shingle; rows that repeat an id are separate rows, labelled with
the smallest id of their component; null ids are passed through and label a component only if it has
no other id; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convlens.llm.components import components
from convlens.llm.words import hashed_words, mix, shingle_hashes
from convlens.sources.staging import stage

SAMPLE_DOCS = 10_000
FREQUENT = 3  # documents of the sample that share a shingle
SHORT = 8
BLOCK = 1024
PAIRS_PER_TASK = 2000


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, at = hashed_words(texts, lower=True)
    return [np.unique(shingle_hashes(words[at[i] : at[i + 1]], k)) for i in range(len(texts))]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def set_id(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each of b bits, as 64-bit numbers; b: a power of two of at
    least twice the size. The halves of a bitmap, added bit by bit, are the bitmap of half the size."""
    bits = max(256, 2 << int(len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(x: np.ndarray) -> np.ndarray:
    half = x.shape[-1] // 2
    return x[..., :half] ^ x[..., half:]


def _differing_bits(x: Column, y: Column) -> Column:
    """Bits in which two bitmaps differ; a bitmap twice as long is folded. Where the lengths differ by
    more (at low thresholds only) the bound is 0: the pair goes on to be verified."""

    def fold(z: Column) -> Column:
        half = (F.size(z) / 2).cast("int")
        return F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.get(z, i).bitwiseXOR(F.get(z, i + half)))

    def count(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)

    return (
        F.when(F.size(x) == F.size(y), count(x, y))
        .when(F.size(x) == 2 * F.size(y), count(fold(x), y))
        .when(2 * F.size(x) == F.size(y), count(x, fold(y)))
        .otherwise(F.lit(0))
    )


def frequent_shingles(docs: DataFrame, k: int, sample: int = SAMPLE_DOCS, least: int = FREQUENT) -> np.ndarray:
    """Shingles that ``least`` of about ``sample`` documents share, from a bounded sample by hash."""
    n = docs.count()
    parts = max(1, n // max(1, sample))
    chosen = docs.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(parts)) == 0) if parts > 1 else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(_bytes(batch.column(0)), k)
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    # copies of a text would make all of its shingles look frequent
    counts = chosen.select("text").distinct().mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least)
    return np.sort(np.array([r["h"] for r in counts.select("h").collect()], np.int64).view(np.uint64))


def prepared(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), cid (id of the set), prefix, bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, cid, prefix, bits = [], [], [], []
                for s in shingle_sets(_bytes(part.column(2)), k):
                    n.append(len(s))
                    if not len(s):
                        cid.append(None), prefix.append(None), bits.append(None)
                        continue
                    late = np.zeros(len(s), bool)
                    if len(frequent):
                        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    size = prefix_size(len(s), percent)
                    first = np.concatenate([s[~late], s[late]])[:size] if late.any() else s[:size]
                    cid.append(set_id(s)), prefix.append(first.view(np.int64)), bits.append(bitmap(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(cid, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["doc_id", "th", "n", "cid", "prefix", "bits"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, th long, n int, cid binary, prefix array<long>, bits array<long>")


def _postings(rows: DataFrame) -> DataFrame:
    """token, cid, n, at: classes that share a prefix shingle, numbered within the shingle."""
    rows = rows.where("n > 0").withColumn("gid", F.xxhash64("n", "prefix"))
    groups = rows.groupBy("gid").agg(F.first("prefix").alias("prefix"))
    members = rows.groupBy("gid", "cid").agg(F.first("n").alias("n"))
    by_token = W.partitionBy("token").orderBy("gid")
    shared = (
        groups.select("gid", F.explode("prefix").alias("token"))
        .select("gid", "token", F.lag("gid").over(by_token).alias("before"), F.lead("gid").over(by_token).alias("after"))
        .where("before is not null or after is not null")
        .select("token", "gid")
    )
    # a group's own members are candidates of one another: they meet under the id of the group
    within = members.groupBy("gid").count().where("count > 1").select(F.col("gid").alias("token"), "gid")
    met = shared.unionByName(within).join(members, "gid").select("token", "cid", "n").distinct()
    met = stage(met.withColumn("at", F.row_number().over(W.partitionBy("token").orderBy("cid"))), "jaccard-met")
    sizes = met.groupBy("token").agg(F.max("at").alias("classes"))
    return met.join(stage(sizes, "jaccard-lists"), "token")


def _differ_at_most(na: Column, nb: Column, percent: int) -> Column:
    """The most that two sets of these sizes can differ in at the threshold: what both have beyond
    the least intersection with 100 * intersection >= percent * union."""
    return na + nb - 2 * F.ceil(F.lit(percent) * (na + nb) / (100 + percent))


def _short_pairs(postings: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of short lists that size and bitmaps allow."""
    short = postings.where(F.col("classes") <= SHORT)
    a = short.select("token", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"))
    b = short.select("token", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    close = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("ia") > F.col("ib"))
    pairs = a.join(b, "token").where(close).select("a", "b", "na", "nb").distinct()
    pairs = pairs.join(bits.select(F.col("cid").alias("a"), F.col("bits").alias("xa")), "a")
    pairs = pairs.join(bits.select(F.col("cid").alias("b"), F.col("bits").alias("xb")), "b")
    near = _differing_bits(F.col("xa"), F.col("xb")) <= _differ_at_most(F.col("na"), F.col("nb"), percent)
    return pairs.where(near).select("a", "b")


def close_pairs(
    sizes: np.ndarray, roots: list[bytes], bits: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, forest: bool
) -> list[tuple[int, int]]:
    """Positions (i of left, j of right) of rows of different roots that size and bitmaps allow; with
    ``forest`` only those that connect what the pairs before them have not connected."""
    _, root = np.unique(np.array(roots, dtype=object), return_inverse=True)
    bits = [x.view(np.uint64) for x in bits]  # of a negative number numpy counts the bits of its absolute value
    length = np.array([len(x) for x in bits])
    tables = [(int(n), right[length[right] == n]) for n in np.unique(length[right])]
    tables = [(n, j, np.stack([bits[k] for k in j])) for n, j in tables]
    out = []
    for i in left.tolist():
        near, far = [], []
        for n, j, table in tables:
            own, other = bits[i], table
            while len(own) > other.shape[1]:
                own = folded(own)
            while other.shape[1] > len(own):
                other = folded(other)
            both = sizes[j] + sizes[i]
            most = both - 2 * -(-percent * both // (100 + percent))
            differ = np.bitwise_count(other ^ own).sum(axis=1, dtype=np.int64)
            fine = (root[j] != root[i]) & (differ <= most) & (j != i)
            fine &= 100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i])
            near.append(j[fine]), far.append(differ[fine])
        j = np.concatenate(near) if near else np.zeros(0, np.int64)
        if forest and len(j):
            j = j[np.argsort(np.concatenate(far), kind="stable")]
            _, first = np.unique(root[j], return_index=True)  # the nearest row of each root
            j = j[first]
            for k in root[j].tolist():
                root[root == k] = root[i]
        out += [(i, k) for k in j.tolist()]
    return out


def _long_pairs(postings: DataFrame, bits: DataFrame, roots: DataFrame | None, percent: int, forest: bool) -> DataFrame:
    """a, b: pairs of long lists that size and bitmaps allow and that are not connected; see close_pairs."""
    rest = postings.where(F.col("classes") > SHORT).withColumn("root", F.col("cid"))
    if roots is not None:
        rest = rest.join(roots.select(F.col("a").alias("cid"), F.col("b").alias("r")), "cid", "left")
        rest = rest.withColumn("root", F.coalesce("r", "cid")).drop("r")
    mixed = rest.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("at").alias("last"))
    blocks = F.floor(F.col("last") / BLOCK).cast("int")
    rest = rest.join(mixed.where("x != y").select("token", blocks.alias("blocks")), "token")
    rest = rest.withColumn("block", F.floor(F.col("at") / BLOCK).cast("int")).join(bits.select("cid", "bits"), "cid")
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks"))))
    rest = rest.select("token", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "cid", "n", "root", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(rows: list[tuple]) -> pa.RecordBatch:
            b1, b2 = rows[0][1], rows[0][2]
            block = np.array([r[3] for r in rows])
            every, found = np.arange(len(rows)), []
            bitmaps = [np.array(r[7], np.int64) for r in rows]
            sizes, roots = np.array([r[5] for r in rows], np.int64), [r[6] for r in rows]
            if b1 == b2:
                found = close_pairs(sizes, roots, bitmaps, every, every, percent, forest)
            elif (block == b1).any() and (block == b2).any():
                found = close_pairs(sizes, roots, bitmaps, every[block == b1], every[block == b2], percent, forest)
            pairs = sorted({(max(rows[i][4], rows[j][4]), min(rows[i][4], rows[j][4])) for i, j in found})
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[0][:3]:
                    yield compared(held)
                    held = []
                held.append(row)
        if held:
            yield compared(held)

    dealt = rest.repartition("token", "b1", "b2").sortWithinPartitions("token", "b1", "b2")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, text of the wanted classes; wanted: cid, doc_id, th of one document of each."""
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), "text")
    found = rows.join(wanted, (rows["th"] == wanted["th"]) & rows["d"].eqNullSafe(wanted["doc_id"]))
    return found.select("cid", "text").dropDuplicates(["cid"])


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int, tasks: int) -> DataFrame:
    """The pairs a, b whose whole texts reach the threshold."""
    pairs = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
    pairs = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
    pairs = pairs.coalesce(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                left, right = (shingle_sets(_bytes(part.column(c)), k) for c in (2, 3))
                keep = []
                for x, y in zip(left, right):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, th, n, root (smallest set id of the component), label (its smallest doc_id) of every row."""
    docs = docs.select("doc_id", "text")
    rows = stage(prepared(docs, k, percent, frequent_shingles(docs, k)), "jaccard-sets")
    classes = (
        rows.where("n > 0").groupBy("cid")
        .agg(F.min("doc_id").alias("label"), F.min(F.struct("doc_id", "th")).alias("one"), F.first("bits").alias("bits"))
    )
    classes = stage(classes.select("cid", "label", "one.doc_id", "one.th", "bits"), "jaccard-classes")
    postings = stage(_postings(rows), "jaccard-postings")
    bits = classes.select("cid", "bits")

    def verified(pairs: DataFrame) -> DataFrame | None:
        n = pairs.count()
        if not n:
            return None
        wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        texts = stage(_texts(docs, classes.select("cid", "doc_id", "th").join(wanted, "cid")), "jaccard-texts")
        return stage(_linked(pairs, texts, k, percent, -(-n // PAIRS_PER_TASK)), "jaccard-links")

    roots = None  # cid (a), smallest cid of its component (b); classes alone are not in it
    pairs = _short_pairs(postings, bits, percent).unionByName(_long_pairs(postings, bits, None, percent, forest=True)).distinct()
    tested = stage(pairs, "jaccard-pairs")
    links = verified(tested)
    if links is not None:
        roots = components(links, "jaccard-components")
    pairs = _long_pairs(postings, bits, roots, percent, forest=False).join(tested, ["a", "b"], "left_anti")
    more = verified(stage(pairs, "jaccard-pairs"))
    if more is not None:
        roots = components(more if roots is None else more.unionByName(roots), "jaccard-components")
    named = classes.select("cid", "label").withColumn("root", F.col("cid"))
    if roots is not None:
        named = named.join(roots.select(F.col("a").alias("cid"), F.col("b").alias("r")), "cid", "left")
        named = named.select("cid", "label", F.coalesce("r", "cid").alias("root"))
        least = named.groupBy("root").agg(F.min("label").alias("least"))
        named = named.join(least, "root").select("cid", "root", F.col("least").alias("label"))
    return rows.select("doc_id", "th", "n", "cid").join(named, "cid", "left").select("doc_id", "th", "n", "root", "label")


def join_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    component = F.when(F.col("n") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    return _labelled(docs, k, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (then text hash). Rows without
    a shingle stay."""
    found = stage(_labelled(docs, k, percent).where("n > 0"), "jaccard-found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    stays = stage(found.groupBy("root").agg(F.min(order).alias("one")), "jaccard-stays")
    is_one = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("th") == F.col("one.th"))
    marked = found.join(stays, "root").withColumn("is_one", is_one)
    gone = marked.where(~F.col("is_one")).select("doc_id", "th").distinct()
    again = marked.where("is_one").groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th")

    def same(rows: DataFrame, other: DataFrame) -> Column:
        return (F.xxhash64(rows["text"]) == other["th"]) & rows["doc_id"].eqNullSafe(other["doc_id"])

    kept = docs.join(gone, same(docs, gone), "left_anti")
    again = stage(again, "jaccard-again")
    if again.isEmpty():
        return kept
    # equal rows that would all stay
    single = kept.join(again, same(kept, again), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same(kept, again), "left_anti").unionByName(single)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
