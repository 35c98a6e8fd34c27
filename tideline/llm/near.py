"""Near-duplicate records (problem 1): hash minima with banding, verification, and connected components.

Texts. The set of ``SHINGLE`` consecutive words of each distinct word sequence is hashed under many universal
functions; a few minima make a band key. The signatures verify a candidate by ``AGREE`` equal bands at least (at a
similarity of 0.5 a pair has 7.5 of them on average and fewer than 2 with a probability of 0.3 %; templates that are 0.08
alike have 2 in one of 3000 pairs; ``agree=1`` asks for one only), its shingle sets then exactly. Equal word sequences are one
node, so copies never meet each other in a band. A key that many nodes share is paired in blocks, in as many tasks as it has pairs of blocks.

Frame hashes. A 64-bit hash is the set of its (block, value) pairs over ``d + r`` blocks; two hashes within ``d`` bits share
at least ``r`` of them. Randomly drawn minima reach full recall at 6 of 64 bits only with some 50 bands, far more data than
the input. So the orderings are not drawn but enumerated: for each choice of ``r`` blocks, the ordering that ranks those
blocks first, whose ``r`` minima are exactly their values. As a band each, these choices miss no pair. Only the first block
of a choice is shuffled on (``d + 1`` copies of a hash); the other ``r - 1`` are sorted out inside the task. A crowded first
block is split by the second, too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.runtime import spread_groups, written

SHINGLE, AGREE, AGREEING_BANDS, LEAST_WORDS = 3, 2, 7.5, 15
NODES_PER_KEY, SAMPLE = 500_000, 5_000
ROWS_PER_GROUP, CROWDED, OCCUPANCY = 250_000, 2_000_000, 64
HUB = 1_000_000


# ---- frame hashes -------------------------------------------------------------------------------------------------


def _blocks(m: int) -> list[tuple[int, int]]:
    """(shift, width) of ``m`` blocks of 64 bits."""
    cuts = [round(64 * k / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _matched_blocks(hashes: int, bits: int) -> int:
    """How many equal blocks make a key: the fewest that leave about ``OCCUPANCY`` hashes under one."""
    r = 2
    while r < 6 and hashes / 2 ** (64 * r / (bits + r)) > OCCUPANCY:
        r += 1
    return r


def _values(h: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    return (h >> np.uint64(block[0])) & np.uint64((1 << block[1]) - 1)


def _pairs_in(h: np.ndarray, s: np.ndarray, head: np.ndarray, second: np.ndarray, bits: int, m: int, r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs within ``bits`` and of different ``s``, each once. ``head``: the first equal block of a row's
    copy; ``second``: its second one if the copy is meant for just that, else -1."""
    blocks = _blocks(m)
    for first in np.unique(head):
        for rest in combinations(range(int(first) + 1, m), r - 1):
            at = np.flatnonzero((head == first) & ((second < 0) | (second == rest[0])))
            key = _values(h[at], blocks[first])
            for b in rest:
                key = (key << np.uint64(blocks[b][1])) | _values(h[at], blocks[b])
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            ends = np.searchsorted(key, key, "right")
            k, p = 1, np.arange(len(key))
            before = [b for b in range(rest[-1]) if b != first and b not in rest]
            while True:
                p = p[p + k < ends[p]]
                if not len(p):
                    break
                x = h[at[p]] ^ h[at[p + k]]
                near = np.flatnonzero(np.bitwise_count(x) <= bits)
                if len(near):
                    a, b, x = at[p[near]], at[p[near] + k], x[near]
                    keep = s[a] != s[b]
                    for other in before:
                        keep &= _values(x, blocks[other]) != 0
                    if keep.any():
                        yield a[keep], b[keep]
                k += 1


def hash_pairs(hashes: DataFrame, bits: int = 6, crowded: int = CROWDED) -> DataFrame:
    """``hashes`` (h long, s long), distinct: (ha, sa, hb, sb), every pair of different ``s`` within ``bits`` bits, once in
    one of its orders. Exact at any size. Null hashes must be left out by the caller."""
    spark = hashes.sparkSession
    nodes = written(hashes)
    n = nodes.count()
    r = _matched_blocks(n, bits)
    m = bits + r
    blocks = _blocks(m)

    def value(b: int) -> Column:
        return F.shiftrightunsigned("h", blocks[b][0]).bitwiseAND(F.lit((1 << blocks[b][1]) - 1))

    copies = nodes.select("h", "s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), value(i).alias("v")) for i in range(bits + 1)])).alias("c"))
    copies = copies.select("h", "s", "c.i", "c.v")
    if n > crowded:
        # At most (bits + 1) * 2**width keys exist, so this list has a fixed bound.
        full = [(x.i, x.v) for x in copies.groupBy("i", "v").count().where(F.col("count") > crowded).collect()]
    else:
        full = []
    one = F.array(F.lit(-1))
    split = one
    for i, v in full:
        split = F.when((F.col("i") == i) & (F.col("v") == v), F.array(*[F.lit(j) for j in range(i + 1, m)])).otherwise(split)
    copies = copies.withColumn("j", F.explode(split)) if full else copies.withColumn("j", F.lit(-1))
    second = F.lit(0).cast("long")
    for b in range(1, m):
        second = F.when(F.col("j") == b, value(b)).otherwise(second) if full else second
    groups = spread_groups(spark, n * (bits + 1), ROWS_PER_GROUP)
    copies = copies.select("h", "s", F.col("i").cast("byte").alias("i"), F.col("j").cast("byte").alias("j"), F.pmod(F.xxhash64("i", "v", "j", second), F.lit(groups)).cast("int").alias("g"))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        h, s = pdf.h.to_numpy().view(np.uint64), pdf.s.to_numpy()
        found = list(_pairs_in(h, s, pdf.i.to_numpy(), pdf.j.to_numpy(), bits, m, r))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
        hh = h.view(np.int64)
        return pd.DataFrame({"ha": hh[a], "sa": s[a], "hb": hh[b], "sb": s[b]})

    return copies.repartitionById(groups, "g").groupBy("g").applyInPandas(pairs, "ha long, sa long, hb long, sb long")


def numbered(rows: DataFrame, name: str) -> Column:
    """A 64-bit number of each different value of ``name``, odd, no two alike: a hash under the first seed that parts all values
    there are. One pass over values that are first made distinct where they are read."""
    values, seed = rows.select(name).distinct(), 0
    while True:
        number = F.xxhash64(F.lit(seed), name).bitwiseOR(F.lit(1).cast("long"))
        all_, different = values.agg(F.count(name), F.count_distinct(F.when(F.col(name).isNotNull(), number))).first()
        if all_ == different:
            return number
        seed += 1


def _frames(frames: DataFrame) -> DataFrame:
    rows = frames.select("frame_id", F.col("perceptual_hash").alias("h"), "stream_id").where("frame_id is not null and perceptual_hash is not null and stream_id is not null")
    return rows.withColumn("s", numbered(rows, "stream_id"))


def frame_links(frames: DataFrame, bits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Links between (hash, stream) nodes, and the frames of every linked node (node, frame_id, stream_id), both written."""
    rows = _frames(frames)
    links = written(hash_pairs(rows.select("h", "s").distinct(), bits))
    node = links.select(F.col("ha").alias("h"), F.col("sa").alias("s")).union(links.select("hb", "sb")).distinct()
    members = written(rows.join(node, ["h", "s"]).select("h", "s", "frame_id").distinct())
    return links, members


def frame_pairs(frames: DataFrame, bits: int = 6) -> DataFrame:
    """(id_a, id_b): all pairs of frames of different streams whose hashes differ in at most ``bits`` bits."""
    links, members = frame_links(frames, bits)
    a = members.select(F.col("h").alias("ha"), F.col("s").alias("sa"), F.col("frame_id").alias("x"))
    b = members.select(F.col("h").alias("hb"), F.col("s").alias("sb"), F.col("frame_id").alias("y"))
    return links.join(a, ["ha", "sa"]).join(b, ["hb", "sb"]).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


# ---- texts --------------------------------------------------------------------------------------------------------


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(words: Column, shingle: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - shingle), lambda k: F.xxhash64(F.slice(words, k + 1, shingle))))


def banding(nodes: int, similarity: float) -> tuple[int, int]:
    """Minima per band and bands: a band agrees at the threshold with a probability of about 1/8, less with more nodes (else
    candidates would grow with their square), and there are so many that ``AGREEING_BANDS`` of them do at any size."""
    rows = max(1, math.floor(math.log(1 / 8) / math.log(similarity) + 1e-9))
    while nodes > NODES_PER_KEY:
        rows, nodes = rows + 1, nodes / 8
    return rows, math.ceil(AGREEING_BANDS / similarity**rows)


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20260101)
    return rng.integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, n, dtype=np.uint64)


def _band_keys(flat: np.ndarray, starts: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Keys of all bands of sets that lie one after another in ``flat`` (none empty). A band's key mixes its ``rows`` minima,
    each of a multiply-add-shift hash."""
    a, b = _universal(rows * bands)
    out = np.empty((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band, np.uint64)
        for k in range(band * rows, band * rows + rows):
            key = (key ^ np.minimum.reduceat((flat * a[k] + b[k]) >> np.uint64(32), starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def _crowded(keys: np.ndarray, hot: dict[int, int]) -> np.ndarray:
    """Number of nodes expected under each key that the sample found crowded, 0 for others."""
    if not hot:
        return np.zeros(len(keys), np.int64)
    known = np.array(sorted(hot), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, np.array([hot[k] for k in known.tolist()], np.int64)[at], 0)


def _sign(groups: int, rows: int, bands: int, hot: dict[int, int], most: int):
    """Rows (g, key, nid, run) of nodes, one per band. The rows of a crowded key are spread over the groups, about ``most`` to
    one; ``_meet`` only hands them on."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                sets = part.shingles.to_list()
                sizes = np.array([len(x) for x in sets])
                keys = _band_keys(np.concatenate(sets).view(np.uint64), np.cumsum(sizes) - sizes, rows, bands).ravel().view(np.int64)
                nid, n = np.repeat(part.nid.to_numpy(), bands), _crowded(keys, hot)
                g = np.where(n > 0, keys % groups + nid % (n // most + 1), keys) % groups
                yield pd.DataFrame({"g": g.astype(np.int32), "key": keys, "nid": nid, "run": np.repeat(part.run.to_numpy(), bands)})

    return sign


MET = "a long, b long, key long, run long, n int"


def _meet(most: int, hot: dict[int, int]):
    """Pairs (a < b) of one group's rows that share a key and are not of one run. The rows of a key that more than ``most``
    nodes share are handed on instead (b is null, n about their number), to be paired in blocks."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf.key.to_numpy(), kind="stable")
        key, nid, run = (pdf[c].to_numpy()[order] for c in ("key", "nid", "run"))
        ends, begins = np.searchsorted(key, key, "right"), np.searchsorted(key, key, "left")
        expected = _crowded(key, hot)
        number = np.where(expected > 0, expected, ends - begins)
        crowded = (number > most) | (expected > 0)
        p, k, found = np.flatnonzero(~crowded), 1, [np.zeros((2, 0), np.int64)]
        while True:
            p = p[p + k < ends[p]]
            if not len(p):
                break
            keep = (run[p] != run[p + k]) | (run[p] == 0)
            a, b = nid[p[keep]], nid[p[keep] + k]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            k += 1
        a, b = np.concatenate(found, axis=1)
        pairs = pd.DataFrame({"a": a, "b": pd.array(b, "Int64"), "key": np.int64(0), "run": np.int64(0), "n": np.int32(0)})
        over = pd.DataFrame({"a": nid, "b": pd.array([pd.NA] * len(nid), "Int64"), "key": key, "run": run, "n": number.astype(np.int32)})[crowded]
        return pd.concat([pairs, over])

    return meet


def _meet_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one key between two blocks of its nodes (or within one)."""
    i, j = pdf.i.iloc[0], pdf.j.iloc[0]
    left, right = (pdf[pdf.block == x] for x in (i, j))
    nid, run, found = right.a.to_numpy(), right.run.to_numpy(), [np.zeros((2, 0), np.int64)]
    for a, r in zip(left.a, left.run, strict=True):
        keep = ((run != r) | (r == 0)) & ((nid > a) if i == j else (nid != a))
        b = nid[keep]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
    a, b = np.concatenate(found, axis=1)
    return pd.DataFrame({"a": a, "b": b})


def _candidates(nodes: DataFrame, count: int, similarity: float, most: int, agree: int) -> DataFrame:
    """(a, b) of nodes that agree in at least ``agree`` bands."""
    rows, bands = banding(count, similarity)
    groups = spread_groups(nodes.sparkSession, count * bands, ROWS_PER_GROUP)
    data, schema = nodes.select("nid", "run", "shingles"), "g int, key long, nid long, run long"
    # Which keys are crowded, from about SAMPLE nodes. It only decides where rows go: a key that many nodes share must not
    # come to one task. A key found here or not gives the same pairs.
    every = max(1, count // SAMPLE)
    seen = data.where(F.pmod(F.xxhash64("nid"), F.lit(every)) == 0).mapInPandas(_sign(groups, rows, bands, {}, most), schema)
    hot = {r[0]: min(r[1] * every, (1 << 31) - 1) for r in seen.groupBy("key").count().where(F.col("count") > max(8, most / every)).toLocalIterator()}
    keys = data.mapInPandas(_sign(groups, rows, bands, hot, most), schema)
    met = written(keys.repartitionById(groups, "g").groupBy("g").applyInPandas(_meet(most, hot), MET))
    blocks = F.ceil(F.col("n") / most).cast("int")
    over = met.where("b is null").withColumn("block", F.pmod(F.xxhash64("a"), blocks).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    over = over.select("a", "key", "run", "block", F.explode(tasks).alias("t")).select("a", "key", "run", "block", "t.i", "t.j")
    more = over.groupBy("key", "i", "j").applyInPandas(_meet_blocks, "a long, b long")
    both = met.where("b is not null").select("a", "b").unionByName(more)
    return both.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= agree).select("a", "b")


def text_links(records: DataFrame, id_col: str, group_col: str, text_col: str, similarity: float = 0.5, least_words: int = LEAST_WORDS, shingle: int = SHINGLE, most: int = 4096, agree: int = AGREE) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between different word sequences of Jaccard similarity at least ``similarity`` that occur in different
    groups, and members (id, g, node), both written. Each sequence is one node however often it occurs; a node is a number of this
    result. Sequences are told apart by 128 bits. Records without id, group or text, or with fewer than ``least_words`` words,
    are left out. Other columns are ignored."""
    rows = records.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), _words(F.col(text_col)).alias("w"))
    rows = rows.where(F.col("id").isNotNull() & F.col("g").isNotNull() & (F.size("w") >= max(least_words, shingle)))
    rows = rows.select("id", "g", F.array_join("w", " ").alias("words")).withColumn("of", F.unhex(F.md5("words")))
    # A node that occurs in one group only carries that group, so candidates within it are left out early; 0 for several.
    nodes = rows.withColumn("run", numbered(rows, "g")).groupBy("of").agg(F.first("words").alias("words"), F.min("run").alias("r1"), F.max("run").alias("r2"))
    run = F.when(F.col("r1") == F.col("r2"), F.col("r1")).otherwise(F.lit(0).cast("long"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("nid"), "of", run.alias("run"), _shingles(F.split("words", " "), shingle).alias("shingles")))
    members = written(rows.select("id", "g", "of").distinct().join(nodes.select("of", F.col("nid").alias("node")), "of").drop("of"))
    spread = nodes.select("nid", "run", "shingles").repartition(2 * nodes.sparkSession.sparkContext.defaultParallelism)
    near = written(_candidates(spread, nodes.count(), similarity, most, agree))
    side = lambda x: nodes.select(F.col("nid").alias(x), F.col("shingles").alias(f"w{x}"))
    both = F.size(F.array_intersect("wa", "wb"))
    met = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("both"), (F.size("wa") + F.size("wb")).alias("sizes"))
    links = written(met.where(F.col("both") >= similarity * (F.col("sizes") - F.col("both"))).select("a", "b"))
    return links, members


def text_pairs(records: DataFrame, id_col: str, group_col: str, text_col: str, similarity: float = 0.5, least_words: int = LEAST_WORDS, agree: int = AGREE) -> DataFrame:
    """(id_a, id_b): records of different groups whose shingle sets are alike enough; copies included."""
    links, members = text_links(records, id_col, group_col, text_col, similarity, least_words, agree=agree)
    both = links.unionByName(members.groupBy("node").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi").select(F.col("node").alias("a"), F.col("node").alias("b")))
    a = members.select(F.col("node").alias("a"), F.col("id").alias("x"), F.col("g").alias("gx"))
    b = members.select(F.col("node").alias("b"), F.col("id").alias("y"), F.col("g").alias("gy"))
    pairs = both.join(a, "a").join(b, "b").where("gx != gy and (a != b or x < y)")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


# ---- connected components -----------------------------------------------------------------------------------------


def components(links: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, component) of undirected links (a long, b long): component is the smallest node reachable.

    Alternating large-star and small-star. Each star needs only the smallest neighbour of a node, a pre-aggregated minimum,
    then one join back; no neighbourhood is collected. Nodes of more than ``hub`` links, of which there are few, are spread over
    as many tasks as they have times that. Nodes without links are not in the result. Loops and repeated links do not matter;
    null ends are left out.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        for large in (True, False):
            # large: all neighbours of u, keep those above u; small: neighbours below u, and u itself.
            ways = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
            least = written(ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.ceil(F.count("*") / hub).cast("int").alias("parts")))
            if (least.agg(F.max("parts")).first()[0] or 0) > 1:
                hubs = written(least.where("parts > 1").select("u", "parts"))  # at most links / hub rows; broadcast by measured size
                z = F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(0)).cast("int")
                met = ways.join(hubs, "u", "left").select("u", "v", z.alias("z"))
                met = met.join(least.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("z")), ["u", "z"])
            else:
                met = ways.join(least, "u")
            if large:
                new = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                new = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            edges = written(new.where("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def found(frames: DataFrame, events: DataFrame) -> DataFrame:
    """record_kind, id_a, id_b: near-equal frames of different streams and near-equal long descriptions of different runs."""
    f = frame_pairs(frames).select(F.lit("frame").alias("record_kind"), "id_a", "id_b")
    e = text_pairs(events, "id", "run_id", "description").select(F.lit("event").alias("record_kind"), "id_a", "id_b")
    return f.unionByName(e)


def classes(frames: DataFrame, events: DataFrame) -> DataFrame:
    """record_kind, id, class_id, links: one row per record; the class is the smallest record id of its connected component,
    links the number of different hashes or texts its own is linked with. A record that is like no other, or cannot be compared
    (no hash, too few words), is a class of its own. Records without id are left out."""
    pairs, rows = frame_links(frames)
    node = written(rows.select("h", "s").distinct().withColumn("node", F.monotonically_increasing_id()))
    end = lambda x: node.select(F.col("h").alias(f"h{x}"), F.col("s").alias(f"s{x}"), F.col("node").alias(x))
    f = written(pairs.join(end("a"), ["ha", "sa"]).join(end("b"), ["hb", "sb"]).select("a", "b"))
    rows = rows.join(node, ["h", "s"]).select("node", F.col("frame_id").alias("id"))
    tl, tm = text_links(events, "id", "run_id", "description")
    same = tm.groupBy("node").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi").select("node")
    out = None
    for kind, edge, member, alone, every in (("frame", f, rows, None, frames.select(F.col("frame_id").alias("id"))), ("event", tl, tm.select("node", "id"), same, events.select("id"))):
        part = components(edge)
        if alone is not None:
            part = part.union(alone.join(part, "node", "left_anti").select("node", F.col("node").alias("component")))
        degree = edge.select("a").union(edge.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
        whole = member.join(part.join(degree, "node", "left"), "node")
        least = whole.groupBy("component").agg(F.min("id").alias("class_id"))
        whole = whole.join(least, "component").select("id", "class_id", "links")
        whole = every.where("id is not null").distinct().join(whole, "id", "left")
        whole = whole.select(F.lit(kind).alias("record_kind"), "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
        out = whole if out is None else out.unionByName(whole)
    return out
