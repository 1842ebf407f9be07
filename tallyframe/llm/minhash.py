"""Near-duplicates by MinHash with sequential Bayesian verification.

Documents with equal shingle sets form a class, whose smallest id stands for it. Classes that share
a band of their signatures are candidates. A candidate pair's signatures are compared batch by
batch: with a uniform prior on the similarity, the pair is dropped as soon as the posterior
probability of reaching the threshold is below a bound, chosen so that all batches together drop a
pair at the threshold with probability MISS at most. Survivors are verified exactly on full sets.

A bucket is not expanded into pairs. First each member meets the bucket's smallest id. In buckets
that the verified links leave in more than one component, the members outside the smallest id's
component then meet all of that component, which streams past them in blocks and yields at most a
link each; last, those outside meet each other in blocks, where a pair is verified unless its ends
are joined already, so a block yields fewer links than it has components. Pairs within a component
are not needed for the components. No link between different components is lost,
beyond the stated miss probabilities of banding (8e-5 for a pair at 0.75, less above) and pruning.

Defined cases: null text and text without words have an empty set and are linked with nothing; a
text of fewer words than a shingle has its whole sequence as one; a null doc_id is linked with
nothing, has a null component and is kept; rows with one doc_id and different texts are documents of
their own, linked by their texts alone; repeated rows are copies; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, components, join_by_key, stored
from .shingles import shared, shingle_set

BANDS, ROWS = 48, 6
THRESHOLD = 75  # hundredths
BATCH, MISS = 48, 1e-5
#: Members compared with each other in one place (those outside with their texts), and pairs verified beside one copy of a text.
PROBES, TARGETS, OUTSIDE, BESIDE = 512, 4096, 512, 64
_rng = np.random.Generator(np.random.PCG64(20240229))
_a = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_b = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_m = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of BANDS * ROWS hash functions over the set."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i : i + 1024, None] * _a + _b).min(0), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    bands = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = (bands * _m).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(30))).view(np.int64)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The smallest number of n agreeing minima at which P(similarity >= threshold) is at least miss.

    Bytes are compared, so unequal minima agree once in 256. With a uniform prior on the chance p of
    agreement, P(p >= t | m of n) is the binomial probability of at most m among n + 1 at t."""
    t, total = threshold + (1 - threshold) / 256, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def missed(needed: list[tuple[int, int]], threshold: float) -> float:
    """At most how likely a pair at the threshold fails any of the tests (n, least)."""
    t = threshold + (1 - threshold) / 256
    return sum(math.comb(n, m) * t**m * (1 - t) ** (n - m) for n, least in needed for m in range(least))


def sequential_tests(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, least): the agreeing minima that a pair needs after each batch. The posterior bound is the
    largest at which a pair at the threshold fails any test with at most probability miss."""
    bound = miss
    while True:
        needed = [(n, least_matches(n, threshold, bound)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]
        if missed(needed, threshold) <= miss:
            return needed
        bound *= 0.8


NEEDED = sequential_tests(THRESHOLD / 100, MISS)


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of the row pairs whose signatures the sequential test keeps; rows broadcast."""
    alive, matches = np.arange(max(len(a), len(b))), None
    for n, least in NEEDED:
        x, y = (z[:, n - BATCH : n] if len(z) == 1 else z[alive, n - BATCH : n] for z in (a, b))
        now = (x == y).sum(1)
        matches = now if matches is None else matches + now
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def _describe(batches):
    for t in batches:
        out: list[list] = [[] for _ in range(4)]
        for text in t.column("text").to_pylist():
            s = shingle_set(text)
            if len(s):
                sig = signature(s)
                row = (len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sig.astype(np.uint8).tobytes(), band_keys(sig))
            else:
                row = (0, None, None, None)
            for column, v in zip(out, row, strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays(
            [t.column("doc_id"), t.column("text_hash"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "n_shingles", "digest", "sig", "keys"],
        )


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the full set, signature bytes, band keys."""
    return _identified(docs).mapInArrow(_describe, "doc_id long, text_hash long, n_shingles long, digest binary, sig binary, keys array<long>")


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _prune(batches):
    for t in batches:
        if t.num_rows:
            keep = pa.array(likely(_matrix(t.column("sig_a")), _matrix(t.column("sig_b"))))
            yield pa.RecordBatch.from_arrays([t.column("a").take(keep), t.column("b").take(keep)], names=["a", "b"])


def pruned(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The (a, b) pairs that the sequential test keeps."""
    a, b = (sigs.select(F.col("id").alias(f"id_{k}"), F.col("sig").alias(f"sig_{k}")) for k in "ab")
    both = pairs.join(a, F.col("a") == F.col("id_a")).join(b, F.col("b") == F.col("id_b")).select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(_prune, "a long, b long")


def _beside(batches):
    """Rows in order of (a, salt, member): a text, then the texts to compare it with."""
    at, own = None, np.empty(0, np.uint64)
    for t in batches:
        found: list[tuple[int, int]] = []
        for a, salt, member, b, text in zip(*(t.column(c).to_pylist() for c in ("a", "salt", "member", "b", "text")), strict=True):
            if not member:
                at, own = (a, salt), shingle_set(text)
            elif at == (a, salt):
                other = shingle_set(text)
                both = shared(own, other)
                if both and 100 * both >= THRESHOLD * (len(own) + len(other) - both):
                    found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct (a, b) pairs whose full sets reach the threshold. Texts move once by id, and
    those on pairs once more; a text on many pairs is repeated once for each BESIDE of them."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BESIDE).alias("salts")).withColumnRenamed("a", "s_a")
    salted = stored(pairs.join(sizes, F.col("a") == F.col("s_a")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt")))
    ends = salted.select(F.col("b").alias("id"), "a", "salt", F.lit(True).alias("member"), "b").union(salted.select("a", "a", "salt", F.lit(False), F.lit(None).cast("long")).distinct())
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(ends, F.col("doc_id") == F.col("id")).select("a", "salt", "member", "b", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "member").mapInArrow(_beside, "a long, b long").distinct()


def _join_main(batches):
    """Rows in order of (g, r, t, target): a few probes are held while the component's members stream
    past; each probe keeps the first member that it is linked with."""

    at, probes, sigs, sets, left = None, [], None, [], []

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for t in batches:
        found = []
        for *group, target, i, sig, text in zip(*(t.column(c).to_pylist() for c in ("g", "r", "t", "target", "id", "sig", "text")), strict=True):
            if group != at:
                at, probes, sigs = group, [], None
            if not target:
                probes.append((i, sig, text))
                continue
            if sigs is None:
                sigs = np.frombuffer(b"".join([p[1] for p in probes]), np.uint8).reshape(len(probes), BANDS * ROWS)
                sets, left = [shingle_set(p[2]) for p in probes], np.arange(len(probes))
            if not len(left):
                continue
            near = left[likely(sigs[left], np.frombuffer(sig, np.uint8)[None])]
            if len(near):
                own = shingle_set(text)
                done = [k for k in near.tolist() if 100 * (n := shared(own, sets[k])) >= THRESHOLD * (len(own) + len(sets[k]) - n)]
                if done:
                    found += [(probes[k][0], i) for k in done]
                    left = left[~np.isin(left, done)]
        yield batch(found)


def main_links(mixed: DataFrame, labels: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): verified links of members outside their bucket's main component with a member of it.

    mixed (id, comp, main). A component meets all who share a bucket with it, in blocks of PROBES
    by TARGETS; rows are the component's members once per block of probes, and no pairs.
    """
    probes = mixed.where("comp <> main").select(F.col("main").alias("g"), "id").distinct()
    wanted = probes.groupBy("g").agg(F.ceil(F.count("*") / PROBES).alias("n_r"))
    of = labels.select(F.col("component_id").alias("m_g"), "id").union(labels.select("component_id", F.col("component_id").alias("id")).distinct()).distinct()
    of = of.union(mixed.where("comp = main and id = main").select("main", "id")).distinct()
    sizes = of.groupBy("m_g").agg(F.ceil(F.count("*") / TARGETS).alias("n_t"))
    plan = wanted.join(sizes, F.col("g") == F.col("m_g")).select(F.col("g").alias("p_g"), "n_r", "n_t")
    plan = stored(plan)
    targets = of.join(plan, F.col("m_g") == F.col("p_g")).select(F.col("p_g").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_r") - 1)).alias("r"), F.pmod(F.xxhash64("id"), F.col("n_t")).alias("t"), F.lit(True).alias("target"), "id")
    asking = probes.join(plan, F.col("g") == F.col("p_g")).select("g", F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_r")).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_t") - 1)).alias("t"), F.lit(False), "id")
    both = texts.join(sigs.withColumnRenamed("id", "doc_id"), "doc_id")
    rows = targets.union(asking).join(both, F.col("id") == F.col("doc_id")).select("g", "r", "t", "target", "id", "sig", "text")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "g", "r", "t").sortWithinPartitions("g", "r", "t", "target").mapInArrow(_join_main, "a long, b long")


def _meet(batches):
    """Rows in order of (key, r, t): within each group, links of probes and targets that join components."""

    def links(rows):
        parent: dict[int, int] = {}

        def root(c):
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        probes, targets = ([x for x in rows if x[0] == side] for side in (True, False))
        if not probes or not targets:
            return
        at = np.array([x[2] for x in targets])
        sigs, sets = np.frombuffer(b"".join([x[3] for x in targets]), np.uint8).reshape(len(targets), -1), {}
        for _, i, comp, sig, text in probes:
            other, own = (at != root(comp)).nonzero()[0], None
            near = other[likely(sigs[other], np.frombuffer(sig, np.uint8)[None])] if len(other) else ()
            for k in map(int, near):
                if root(targets[k][2]) == root(comp):
                    continue
                own = shingle_set(text) if own is None else own
                if k not in sets:
                    sets[k] = shingle_set(targets[k][4])
                both = shared(own, sets[k])
                if 100 * both >= THRESHOLD * (len(own) + len(sets[k]) - both):
                    x, y = root(comp), root(targets[k][2])
                    parent[y] = x
                    at[at == y] = x
                    yield (i, targets[k][1])

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    at, rows = None, []
    for t in batches:
        for *group, probe, i, comp, sig, text in zip(*(t.column(c).to_pylist() for c in ("key", "r", "t", "probe", "id", "comp", "sig", "text")), strict=True):
            if group != at:
                yield batch(list(links(rows)))
                at, rows = group, []
            rows.append((probe, i, comp, sig, text))
    yield batch(list(links(rows)))


def outside_links(mixed: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): verified links across components among a bucket's members outside its main component,
    enough to join what they join. Buckets with the same such members are met once."""
    m = mixed.where("comp <> main").select("key", "id", "comp")
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("y")]
    stats = m.groupBy(F.col("key").alias("k")).agg(*same, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    one = stored(stats.groupBy("n", "x", "y").agg(F.min("k").alias("k")).select("k", "n"))
    rows = stored(m.join(one, F.col("key") == F.col("k")).select("key", "id", "comp", "n"))
    r = t = F.ceil(F.col("n") / OUTSIDE)
    targets = rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), r - 1)).alias("r"), F.pmod(F.xxhash64("id"), t).alias("t"), F.lit(False).alias("probe"), "id", "comp")
    probes = rows.select("key", F.pmod(F.xxhash64("id", F.lit(1)), r).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), t - 1)).alias("t"), F.lit(True), "id", "comp")
    both = texts.join(sigs.withColumnRenamed("id", "doc_id"), "doc_id")
    every = targets.union(probes).join(both, F.col("id") == F.col("doc_id")).select("key", "r", "t", "probe", "id", "comp", "sig", "text")
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(parts, "key", "r", "t").sortWithinPartitions("key", "r", "t").mapInArrow(_meet, "a long, b long")


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component_id) after more links: only components are joined, not their members again."""
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("component_id"))
    start = stored(labels.union(ends))
    a, b = (start.select(F.col("id").alias(f"{k}_id"), F.col("component_id").alias(f"{k}_comp")) for k in "ab")
    between = links.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id")).select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    moved = components(between).select(F.col("id").alias("component_id"), F.col("component_id").alias("moved"))
    sizes = start.groupBy("component_id").agg(F.count("*").alias("n")).join(moved, "component_id", "left")
    return join_by_key(start, stored(sizes), ["component_id"], "n").select("id", F.coalesce("moved", "component_id").alias("component_id"))


def minhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash: a row per input row."""
    feats = stored(described(docs), TEXTS)
    named = _identified(docs)
    usable = feats.where("digest is not null and doc_id is not null")
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("low")
    classes = stored(feats.where("digest is not null").groupBy("digest").agg(low, F.count("*").alias("n")).select("digest", "n", F.col("low.doc_id").alias("rep"), F.col("low.text_hash").alias("rep_hash"), F.monotonically_increasing_id().alias("id")))
    if not usable.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        usable, named = usable.dropDuplicates(["doc_id", "text_hash"]), named.dropDuplicates(["doc_id", "text_hash"])
    shown = classes.select("id", "rep", "rep_hash")
    reps = usable.join(shown, (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))
    buckets = reps.select(F.explode("keys").alias("key"), "id")
    often = buckets.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = stored(buckets.join(often, F.col("key") == F.col("k")).select("key", "id", "first", "n"))
    star = stored(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    wanted = stored(members.select("id").distinct())
    sigs = stored(reps.select("id", "sig").join(wanted, "id", "left_semi"))
    own = shown.join(wanted, "id", "left_semi").withColumnRenamed("id", "class")
    texts = named.join(own, (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select(F.col("class").alias("doc_id"), "text")
    texts = stored(texts)
    links = stored(verified(pruned(star, sigs), texts), TEXTS)
    labels = stored(components(links))
    m = members.where("n > 2").select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("comp"))
    m = stored(m)
    mains = m.groupBy(F.col("key").alias("k")).agg(F.min_by("comp", "id").alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("k", "main")
    mixed = stored(m.join(mains, F.col("key") == F.col("k")).select("key", "id", "comp", "main"))
    if not mixed.isEmpty():
        found = stored(main_links(mixed, labels, sigs, texts).union(outside_links(mixed, sigs, texts)), TEXTS)
        if not found.isEmpty():
            labels = stored(joined_labels(labels, found))
    linked = labels.join(classes.select("id", "rep"), "id")
    least = stored(linked.groupBy("component_id").agg(F.min("rep").alias("least"), F.count("*").alias("members")))
    told = join_by_key(labels, least, ["component_id"], "members").select("id", "least")
    by_class = stored(classes.join(told, "id", "left").select("digest", "n", F.coalesce("least", "rep").alias("component")))
    out = join_by_key(feats.select("doc_id", "n_shingles", "text_hash", "digest"), by_class, ["digest"], "n")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash").select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")
