"""Near-duplicate documents by HyperMinHash signatures, confirmed on full shingle sets.

1. Each document's distinct five-word shingles give ``REGISTERS`` minima, each kept as its count
   of leading zeros (6 bits) and the ten bits after (a compressed register); four registers are
   one band, held as one long.  Documents with equal sets become one class at once.
2. Classes that share a band are compared on their registers: the share of equal ones, corrected
   for chance collisions, must come within ``DEVIATIONS`` standard deviations of the threshold.
   What remains connected is a loose family; it holds all links of its members.
3. Within each family the full sets decide.  The search walks from linked documents to those not
   reached yet, so a family of copies costs one comparison a document, and only links that join
   something new are written, never all pairs.
4. A family too large for one block first compares every member with ``HUBS`` of its members, which
   takes each text to one block.  Those that the hubs join are one component; only the rest of the
   family meets the rest and that component, block by block.

Large band groups meet hubs of their own in the same way, on registers, before only their rest is
compared block by block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

U = np.uint64
BANDS, ROWS, MANTISSA = 20, 4, 10
REGISTERS = BANDS * ROWS
#: Members of a band group, members of a family, and shingles of a family that one block takes.
GROUP_BLOCK, FAMILY_BLOCK, FAMILY_SHINGLES = 1024, 512, 1 << 20
#: Members that a large family is compared with first.
HUBS = 4
DEVIATIONS = 4.5

_FACTOR = words.mix(np.arange(1, REGISTERS + 1, dtype=U)) | U(1)
_SHIFT = words.mix(np.arange(1001, 1001 + REGISTERS, dtype=U))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Compressed registers of a set of shingle hashes: leading zeros, then mantissa bits."""
    least = np.full(REGISTERS, ~U(0))
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _FACTOR + _SHIFT).min(0))
    value = (least >> U(12)).astype(np.float64)  # 52 bits: exact
    fraction, exponent = np.frexp(value)
    zeros = 52 - exponent
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64) * (value > 0)
    return (zeros.clip(0, 52) << MANTISSA | mantissa.clip(0)).astype(np.uint16)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """The registers as one int64 for each band."""
    return signature.view("<i8")


def registers_of(bands: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bands).view("<u2")


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard likeness from the number of equal registers of sets of n and m shingles.

    Two unrelated minima share a register by chance: with densities n exp(-nx) and m exp(-mx) and
    cells about 0.72 x / 2**MANTISSA wide, with probability 0.72 nm / (n + m)**2 / 2**MANTISSA.
    """
    n, m = np.asarray(n, np.float64), np.asarray(m, np.float64)
    chance = 0.72 * n * m / (n + m) ** 2 / (1 << MANTISSA)
    return (equal / REGISTERS - chance) / (1 - chance)


def _loosened(percent: int) -> float:
    t = percent / 100
    return t - DEVIATIONS * math.sqrt(t * (1 - t) / REGISTERS)


SIGNED = "node long, n_shingles long, d1 long, d2 long, bands array<long>"


def _sign(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, numbers = batch.column("text"), batch.column("node")
        for a, b in common.slices(column):
            data, offsets = common.text_bytes(column.slice(a, b - a))
            hashes, _, _, of = words.word_hashes(data, offsets)
            sets = words.shingles(hashes, of)
            rows = np.zeros((b - a, REGISTERS), np.uint16)
            digest = np.zeros((2, b - a), U)
            for i, s in enumerate(sets):
                if len(s):
                    rows[i] = registers(s)
                    digest[:, i] = words.mix(s).sum(dtype=U), words.mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(bands_of(rows).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [numbers.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), bands],
                ["node", "n_shingles", "d1", "d2", "bands"],
            )


def signatures(rows: DataFrame) -> DataFrame:
    """node, number of shingles, a digest of the set (d1, d2), and the signature, of each row of ``rows`` (node, text)."""
    return common.map_batches(rows.select("node", "text"), _sign, SIGNED)


def _groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key; a partition has its keys together."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        key = np.stack([t[k].to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), t.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = key[:, a].tolist()
            if held and now != last:
                yield pa.concat_tables(held)
                held = []
            last = now
            held.append(t.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def _walk(n: int, linked: Callable[[int, np.ndarray], np.ndarray], reached: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (from, to) of a spanning forest; ``linked`` says which candidates a node links to.  Where
    some nodes are ``reached`` already, only links from them."""
    begun, rest = np.flatnonzero(reached).tolist(), np.flatnonzero(~reached)
    once = bool(begun)
    while len(rest) and (begun or not once):
        queue, rest = (begun, rest) if begun else ([int(rest[0])], rest[1:])
        begun = []
        while queue and len(rest):
            i = queue.pop()
            found = linked(i, rest)
            if found.any():
                reached = rest[found]
                rest = rest[~found]
                queue.extend(reached.tolist())
                yield from ((i, int(j)) for j in reached)


def _list_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return registers_of(column.combine_chunks().flatten().to_numpy().reshape(len(column), BANDS))


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


class Signed:
    """Members of a band group, compared on their registers."""

    def __init__(self, t: pa.Table, cut: float):
        self.ids, self.n, self.sig, self.cut = t["node"].to_numpy(), t["n_shingles"].to_numpy(), _list_matrix(t["bands"]), cut

    def linked(self, i: int, rest: np.ndarray) -> np.ndarray:
        return estimate((self.sig[rest] == self.sig[i]).sum(1), self.n[rest], self.n[i]) >= self.cut


def _compare(batches, task: list[str], cut: float) -> Iterator[pa.RecordBatch]:
    """Loose links of each task's members; those that are ``joined`` already are not compared with each other."""
    out: list[tuple[int, int]] = []
    for t in _groups(batches, task):
        m = Signed(t, cut)
        out.extend((int(m.ids[i]), int(m.ids[j])) for i, j in _walk(len(m.ids), m.linked, t["joined"].to_numpy()))
        if len(out) > 10_000:
            yield _links(out)
            out = []
    if out:
        yield _links(out)


class Members:
    """Members of a family, with the full sets that decide on links."""

    def __init__(self, t: pa.Table, percent: int, cut: float):
        self.ids, self.bands, self.percent, self.cut = t["node"].to_numpy(), _list_matrix(t["bands"]), percent, cut
        self.sets: list[np.ndarray] = []
        for batch in t.select(["text"]).to_batches():
            for a, b in common.slices(batch.column(0)):
                data, offsets = common.text_bytes(batch.column(0).slice(a, b - a))
                hashes, _, _, of = words.word_hashes(data, offsets)
                self.sets += words.shingles(hashes, of)
        self.n = np.array([len(s) for s in self.sets])

    def linked(self, i: int, rest: np.ndarray) -> np.ndarray:
        """Which of ``rest`` the member ``i`` is linked with."""
        n, percent = self.n, self.percent
        low, high = np.minimum(n[rest], n[i]), np.maximum(n[rest], n[i])
        maybe = (100 * low >= percent * high) & (low > 0)
        maybe &= estimate((self.bands[rest] == self.bands[i]).sum(1), n[rest].clip(1), max(n[i], 1)) >= self.cut
        for k in np.flatnonzero(maybe):
            both = len(np.intersect1d(self.sets[i], self.sets[rest[k]], assume_unique=True))
            maybe[k] = 100 * both >= percent * (n[i] + n[rest[k]] - both)
        return maybe


def _confirm(batches, percent: int, cut: float) -> Iterator[pa.RecordBatch]:
    """Links of each pair of blocks; members that are ``joined`` already are not compared with each other."""
    for t in _groups(batches, ["family", "i", "j"]):
        m = Members(t, percent, cut)
        if out := [(int(m.ids[i]), int(m.ids[j])) for i, j in _walk(len(m.ids), m.linked, t["joined"].to_numpy())]:
            yield _links(out)


def _star(batches, keys: dict[str, str], members: Callable[[pa.Table], Members | Signed]) -> Iterator[pa.RecordBatch]:
    """Of each member of a block, the hubs that it is linked with: as bits, and by node.  A hub is
    linked with itself.  ``keys`` tell groups apart."""
    for t in _groups(batches, [*keys, "block"]):
        m, hub = members(t), t["hub"].to_numpy()
        own = np.flatnonzero(hub < 0)
        if not len(own):
            continue
        mask, linked = np.zeros(len(own), np.int32), [[] for _ in own]
        for h in np.flatnonzero(hub >= 0).tolist():
            same = m.ids[own] == m.ids[h]
            for k in np.flatnonzero(m.linked(h, own) | same).tolist():
                mask[k] |= 1 << int(hub[h])
                if not same[k]:
                    linked[k].append(int(m.ids[h]))
        group = [t[k].take(pa.array(own)).combine_chunks() for k in keys]
        yield pa.RecordBatch.from_arrays([*group, pa.array(m.ids[own]), pa.array(mask), pa.array(linked, pa.list_(pa.int64()))], [*keys, "node", "mask", "hubs"])


def _starred(rows: DataFrame, keys: dict[str, str], columns: DataFrame | None, members: Callable[[pa.Table], Members | Signed]) -> DataFrame:
    """keys, node, mask and hubs of every member of large groups (``rows``: keys, node, blocks): each
    member, in one block, meets the hubs.  ``columns`` are joined by node, if rows lack them."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("node"), "node"))
    hubs = rows.withColumn("hub", turn - 1).where(F.col("hub") < HUBS)
    hubs = hubs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    own = rows.withColumn("hub", F.lit(-1)).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    meet = own.unionByName(hubs).drop("blocks")
    meet = meet if columns is None else meet.join(columns, "node")
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", node long, mask int, hubs array<long>"
    return common.stage(common.map_batches(_dealt(meet, [*keys, "block"]), lambda b: _star(b, keys, members), schema), "stars")


def _with_joined(star: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node and joined: what hubs join, from the hub with the most members on, as hubs that share
    a member are joined too."""
    counts = [F.sum(F.getbit("mask", F.lit(i)).cast("long")).alias(f"n{i}") for i in range(HUBS)]
    most = F.greatest(*[f"n{i}" for i in range(HUBS)])
    joined = F.coalesce(*[F.when(F.col(f"n{i}") == most, F.lit(1 << i)) for i in range(HUBS)])
    for _ in range(HUBS):
        joined = F.aggregate("masks", joined, lambda a, m: F.when(a.bitwiseAND(m) != 0, a.bitwiseOR(m)).otherwise(a))
    hub_sets = star.groupBy(*keys).agg(F.collect_set("mask").alias("masks"), *counts).select(*keys, joined.alias("of_hubs"))
    return star.join(hub_sets, keys).select(*keys, "node", (F.col("mask").bitwiseAND(F.col("of_hubs")) != 0).alias("joined"))


def _open_pairs(star: DataFrame, keys: list[str], size: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """keys, node, joined, i and j: the pairs of blocks in which the rest of a large group meets the
    rest, and those that are joined; ``size`` tells how many blocks each of the two fills."""
    rows = star.join(size(star.where("not joined"), "rest_blocks"), keys).join(size(star.where("joined"), "joined_blocks"), keys)
    at = F.pmod(F.xxhash64("node"), F.when(F.col("joined"), F.col("joined_blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    rests, joins = (F.sequence(F.lit(0), F.col(c).cast("int") - 1) for c in ("rest_blocks", "joined_blocks"))
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    own = F.col("block")
    of_rest = F.concat(F.transform(rests, lambda o: pair(F.least(own, o), F.greatest(own, o))), F.transform(joins, lambda o: pair(own, F.col("rest_blocks") + o)))
    of_joined = F.transform(rests, lambda o: pair(o, F.col("rest_blocks") + own))
    rows = rows.withColumn("block", at).select(*keys, "node", "joined", F.explode(F.when(F.col("joined"), of_joined).otherwise(of_rest)).alias("pair"))
    return rows.select(*keys, "node", "joined", "pair.*")


def _size(members: DataFrame, name: str) -> DataFrame:
    """Blocks that each family's members fill."""
    return members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(F.sum("n_shingles") / FAMILY_SHINGLES)).alias(name))


def _dealt(df: DataFrame, task: list[str]) -> DataFrame:
    return df.repartition(*task).sortWithinPartitions(*task, "node")


def _confirmed(rows: DataFrame, held: DataFrame, percent: int, cut: float) -> DataFrame:
    """Links (a, b) that connect what is connected by links within each family of ``held``."""
    held = common.stage(rows.join(held.join(_size(held, "blocks"), "family"), "node"), "family-texts")
    schema, task = "a long, b long", ["family", "i", "j"]
    small = held.where("blocks = 1").select("node", "text", "family", "bands", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("joined"))
    found = common.map_batches(_dealt(small, task), lambda b: _confirm(b, percent, cut), schema)

    # large families: every member, in one block, meets the hubs, and then the rest what is left
    large = held.where("blocks > 1")
    star = _starred(large.select("node", "text", "family", "bands", "blocks"), {"family": "long"}, None, lambda t: Members(t, percent, cut))
    found = found.union(star.select(F.col("node").alias("a"), F.explode("hubs").alias("b")))
    star = common.stage(large.select("node", "n_shingles").join(_with_joined(star, ["family"]), "node"), "starred")
    open_ = large.select("node", "text", "bands").join(_open_pairs(star, ["family"], _size), "node")
    return found.union(common.map_batches(_dealt(open_, task), lambda b: _confirm(b, percent, cut), schema))


def _band_size(members: DataFrame, name: str) -> DataFrame:
    """Blocks that each band group's members fill."""
    return members.groupBy("pos", "key").agg(F.ceil(F.count("*") / GROUP_BLOCK).alias(name))


def _loose(reps: DataFrame, cut: float) -> DataFrame:
    """Links (a, b) that connect what registers say is alike, of the classes ``reps`` (node, n_shingles,
    bands) that share a band.

    A band's members are one task, or, if they are many, blocks: each member meets the hubs in its own
    block, and only what they do not join meets the others, so a band of copies goes out hardly more
    than twice, however large.
    """
    keys = reps.select("node", F.posexplode("bands").alias("pos", "key"))
    groups = common.stage(keys.join(keys.groupBy("pos", "key").agg(F.count("*").alias("n")).where("n > 1"), ["pos", "key"]), "band-groups")
    schema, task = "a long, b long", ["pos", "key"]
    one = groups.where(F.col("n") <= GROUP_BLOCK).drop("n").join(reps, "node").withColumn("joined", F.lit(False))
    found = common.map_batches(_dealt(one, task), lambda b: _compare(b, task, cut), schema)
    hot = groups.where(F.col("n") > GROUP_BLOCK).select("node", "pos", "key", F.ceil(F.col("n") / GROUP_BLOCK).alias("blocks"))
    if not hot.limit(1).count():
        return found
    star = _starred(hot, {"pos": "int", "key": "long"}, reps, lambda t: Signed(t, cut))
    found = found.union(star.select(F.col("node").alias("a"), F.explode("hubs").alias("b")))
    open_ = _open_pairs(common.stage(_with_joined(star, task), "starred"), task, _band_size).join(reps, "node")
    pairs = [*task, "i", "j"]
    return found.union(common.map_batches(_dealt(open_, pairs), lambda b: _compare(b, pairs, cut), schema))


def components(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, n_shingles) of ``rows`` (node, text), and (node, component) of the linked ones; a
    component is its smallest node.  Nodes are distinct, but for null ones, which link with nothing."""
    cut = _loosened(percent)
    signed = common.stage(signatures(rows), "signed")
    usable = signed.where("n_shingles > 0 and node is not null")
    # copies meet map-side first; only sets met again are kept, in a table, so that the join back is
    # of two plain exchanges, of which Spark can split a hot one
    classes = usable.groupBy("d1", "d2", "n_shingles").agg(F.min("node").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    classes = common.stage(classes, "copies")
    member = usable.join(classes, ["d1", "d2", "n_shingles"], "left").withColumn("rep", F.coalesce("rep", "node"))
    member = common.stage(member.select("node", "rep", "n_shingles", "bands"), "members")
    reps = common.stage(member.where("node = rep").select("node", "n_shingles", "bands"), "classes")
    family = common.connected_components(_loose(reps, cut)).withColumnRenamed("component", "family")
    held = common.stage(family.join(reps, "node").select("node", "family", "n_shingles", "bands"), "families")
    links = _confirmed(rows.where("text is not null and node is not null"), held, percent, cut)
    copies = member.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return signed.select("node", "n_shingles"), common.connected_components(links.union(copies))


def _repeats(docs: DataFrame) -> bool:
    """Whether rows share a doc_id."""
    return docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def _nodes(docs: DataFrame) -> DataFrame:
    """node, doc_id, tie (a hash of the text) and text of each distinct row (doc_id, text) with an id."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.groupBy("doc_id", "tie").agg(F.min("text").alias("text"))
    return common.stage(rows.select(F.monotonically_increasing_id().alias("node"), "doc_id", "tie", "text"), "nodes")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; a
    component's id is its smallest doc_id, and that document is kept.  A text without words (or
    null) links with nothing.  Rows that share a doc_id but not a text are linked as documents of
    their own; a row without doc_id links with nothing, has no component and is kept.  An empty
    table gives no rows; other columns are ignored.
    """
    if _repeats(docs):
        nodes = _nodes(docs)
        signed, of = components(nodes.select("node", "text"), percent)
        known = nodes.select("node", "doc_id", "tie").join(signed, "node").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        known = known.join(least, "component").select("doc_id", "tie", "n_shingles", "component_id")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"))
        out = rows.where("doc_id is not null").join(known, ["doc_id", "tie"]).drop("tie")
        alone = signatures(docs.where("doc_id is null").select(F.lit(None).cast("long").alias("node"), "text"))
        out = out.unionByName(alone.select(F.col("node").alias("doc_id"), "n_shingles", F.col("node").alias("component_id")))
    else:
        signed, of = components(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), percent)
        out = signed.join(of, "node", "left").select(F.col("node").alias("doc_id"), "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: that of the smallest doc_id.

    Of rows that share it, the one with the smallest hash of its text stays; of rows equal in both,
    the one with the smallest hash of all columns.  Rows without doc_id all stay.
    """
    names = docs.columns
    if not _repeats(docs):
        signed, of = components(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), percent)
        gone = of.where("node <> component").select(F.col("node").alias("doc_id"))
        return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    nodes = _nodes(docs)
    _, of = components(nodes.select("node", "text"), percent)
    known = nodes.select("node", "doc_id", "tie").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min(F.struct("doc_id", "tie")).alias("least")).select("least.*")
    of_id, of_tie, tie, turn = common.unused(docs, "of_id", "of_tie", "tie", "turn")
    least = least.toDF(of_id, of_tie)
    rows = docs.withColumn(tie, F.xxhash64("text"))
    rows = rows.join(least, (F.col("doc_id").cast("long") == F.col(of_id)) & (F.col(tie) == F.col(of_tie)), "left_semi")
    one = Window.partitionBy("doc_id", tie).orderBy(F.xxhash64(*common.columns(names)))
    rows = rows.withColumn(turn, F.row_number().over(one)).where(F.col(turn) == 1).select(common.columns(names))
    return rows.unionByName(docs.where("doc_id is null"))
