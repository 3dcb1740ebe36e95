"""The trie of shared conversation prefixes, found block by block.

A prefix is known by a 128-bit digest: the exclusive or of hashes of its turns with their places, so that a
conversation of any length is digested in many tasks. Conversations are cut into blocks of a fixed number of turns.
First they are grouped by the digests at the ends of their blocks: equal blocks after equal prefixes become one
row, however many conversations share them. Then the turns of these rows become nodes; only where several blocks
follow one prefix do their inner turns have to be compared.

What a node says of its subtree is a sum over its members: a node belongs to its smallest member, whose own nodes
are the end of its path. So a conversation brings the bytes of its path, the bytes of its own nodes and whether its
last node is a leaf, and these are added up along the same blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lookup import Lookup
from .common import Scratch, partitions, ranked

#: Turns of a block.
BLOCK_TURNS = 8
#: Conversation ids of one node that are written out together.
_RUN_IDS = 1 << 16
_TURN = ["role", "text"]


def _key(a: Column, b: Column) -> Column:
    return F.concat(F.hex(a), F.lit(":"), F.hex(b))


def _with_digests(turns: DataFrame, *extra: str) -> DataFrame:
    """Narrow turns: ``conv``, ``digest`` of role and text, ``bytes`` of the text; null is empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in _TURN)
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return turns.select("conv", *extra, F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def ordered_turns(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv``, ``pos`` (from 0), ``digest``, ``bytes`` of every turn, by turn (null first), equal turns by digest."""
    named = df.select(F.col("conv_id").cast("long").alias("conv"), "turn", *_TURN).where("conv IS NOT NULL")
    narrow = _with_digests(named, "turn")
    placed = ranked(narrow, ["conv"], ["turn", "digest"], "pos", scratch)
    return scratch.save(placed.select("conv", "pos", "digest", "bytes"), "turns")


def rebuilt(turns: DataFrame, scratch: Scratch, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: ``(turns, conversations)``.

    Conversation ``c`` begins with the first ``h`` turns of conversation ``c - c % family`` (``h`` = crc32 of
    ``c`` in decimal, modulo ``most``) and goes on with its own turns after its first ``h``. ``turns`` has ``conv``,
    ``depth`` (from 1), ``digest``, ``bytes``; ``conversations`` has ``conv`` and ``turns`` (0 is possible).
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("long")
    base = F.col("conv") - F.col("conv") % family
    own = scratch.save(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")), "own")
    of_base = own.select(F.col("conv").alias("base"), F.col("own").alias("of_base"))
    convs = own.select("conv", "own", base.alias("base"), h.alias("h")).join(of_base, "base", "left")
    head = F.least("h", F.coalesce("of_base", F.lit(0)))
    convs = scratch.save(
        convs.select("conv", "own", "base", "h", (F.col("h") - head).alias("short"))
        .withColumn("turns", F.col("h") - F.col("short") + F.greatest(F.col("own") - F.col("h"), F.lit(0))),
        "convs",
    )
    # A conversation has any number of turns, its head less than `most`: only the tail's join can be skewed.
    heads = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv", "base")
    heads = heads.join(convs.select("conv", "base", "h"), "base").where("pos < h")
    heads = heads.select("conv", (F.col("pos") + 1).alias("depth"), "digest", "bytes")
    moved = convs.where("short > 0").select("conv", "short", F.col("own").alias("rows"))
    tails = Lookup(scratch.save(moved, "moved"), "conv", "rows").attach(turns.where(F.col("pos") >= h), F.col("conv"), {"short": 0})
    tails = tails.select("conv", (F.col("pos") + 1 - F.col("short")).alias("depth"), "digest", "bytes")
    return scratch.save(heads.unionAll(tails), "rebuilt"), convs.select("conv", "turns")


def _blocks(turns: DataFrame, scratch: Scratch, block_turns: int) -> DataFrame:
    """One row per block: ``conv``, ``k``, ``start`` and ``end`` (prefix digests), and per turn ``a``, ``b`` (digest of the
    prefix that it ends), ``bytes`` and ``ahead`` (bytes of the turns before it)."""
    depth = F.col("depth")
    lanes = turns.select(
        "conv",
        depth,
        F.floor((depth - 1) / block_turns).alias("k"),
        "bytes",
        F.xxhash64(F.lit("a"), "digest", depth).alias("a"),
        F.xxhash64(F.lit("b"), depth, "digest").alias("b"),
    )
    spread = lanes.repartitionByRange(partitions(turns.sparkSession), "conv", "k").sortWithinPartitions("conv", "depth")

    def chain(batches: Iterator) -> Iterator:
        import pyarrow as pa

        carry = {"conv": None, "a": 0, "b": 0, "bytes": 0}

        def out(columns: dict[str, np.ndarray]):
            conv, k = columns["conv"], columns["k"]
            new_conv = np.diff(conv, prepend=conv[0]) != 0
            new_conv[0] = conv[0] != carry["conv"]
            first = np.maximum.accumulate(np.where(new_conv, np.arange(len(conv)), 0))
            running = {}
            for lane, accumulate in (("a", np.bitwise_xor.accumulate), ("b", np.bitwise_xor.accumulate), ("bytes", np.cumsum)):
                took = columns[lane].copy()
                begins = 0 if new_conv[0] else carry[lane]
                total = accumulate(took)
                before = np.where(first > 0, total[np.maximum(first, 1) - 1], 0)
                if lane == "bytes":
                    running[lane] = total - before + np.where(first == 0, begins, 0)
                else:
                    running[lane] = total ^ before ^ np.where(first == 0, begins, 0)
            carry.update({lane: int(values[-1]) for lane, values in running.items()}, conv=int(conv[-1]))
            edge = new_conv | (np.diff(k, prepend=k[0]) != 0)
            edge[0] = True
            at = np.flatnonzero(edge)
            ends = np.append(at, len(conv)).astype(np.int32)
            lists = [running["a"], running["b"], columns["bytes"], running["bytes"] - columns["bytes"]]
            begin = [running[lane][at] ^ columns[lane][at] for lane in ("a", "b")]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(columns["part"][at]),
                    pa.array(conv[at]),
                    pa.array(k[at]),
                    *map(pa.array, begin),
                    *(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)) for values in lists),
                ],
                names=["part", "conv", "k", "a0", "b0", "a", "b", "bytes", "ahead"],
            )

        names, rest = ["part", "conv", "k", "bytes", "a", "b"], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = {c: np.asarray(batch.column(c)) for c in names}
            if rest is not None:
                columns = {c: np.concatenate([rest[c], columns[c]]) for c in names}
            # The last block may go on in the next batch.
            last = (columns["conv"] == columns["conv"][-1]) & (columns["k"] == columns["k"][-1])
            cut = int(np.argmax(last))
            rest = {c: values[cut:] for c, values in columns.items()}
            if cut:
                yield out({c: values[:cut] for c, values in columns.items()})
        if rest is not None:
            yield out(rest)

    schema = "part int, conv long, k long, a0 long, b0 long, a array<long>, b array<long>, bytes array<long>, ahead array<long>"
    local = scratch.save(spread.select(F.spark_partition_id().alias("part"), "*").mapInArrow(chain, schema), "local_blocks")
    # Digests run on over the parts of a conversation that is cut; each part begins with one such conversation at most.
    sums = local.groupBy("conv", "part").agg(
        F.max(
            F.struct(
                "k",
                F.element_at("a", -1).alias("a"),
                F.element_at("b", -1).alias("b"),
                (F.element_at("ahead", -1) + F.element_at("bytes", -1)).alias("bytes"),
            )
        ).alias("end")
    )
    cut = sums.groupBy("conv").count().where("count > 1").select("conv")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = sums.join(cut, "conv").select(
        "conv",
        "part",
        *[F.coalesce(F.bit_xor(f"end.{c}").over(before), F.lit(0)).alias(f"{c}_before") for c in ("a", "b")],
        F.coalesce(F.sum("end.bytes").over(before), F.lit(0)).alias("bytes_before"),
    )
    moved = scratch.save(moved, "cut_conversations")
    # At most two conversations of a part are cut, so the number of parts bounds this table.
    joined = local.join(F.broadcast(moved), ["conv", "part"], "left")
    a, b, ahead = (F.coalesce(f"{c}_before", F.lit(0)) for c in ("a", "b", "bytes"))
    blocks = joined.select(
        "conv",
        "k",
        _key(F.col("a0").bitwiseXOR(a), F.col("b0").bitwiseXOR(b)).alias("start"),
        _key(F.element_at("a", -1).bitwiseXOR(a), F.element_at("b", -1).bitwiseXOR(b)).alias("end"),
        F.transform("a", lambda x: x.bitwiseXOR(a)).alias("a"),
        F.transform("b", lambda x: x.bitwiseXOR(b)).alias("b"),
        "bytes",
        F.transform("ahead", lambda x: x + ahead).alias("ahead"),
    )
    return scratch.save(blocks, "blocks")


_NODE = ["key", "parent", "depth", "bytes", "ahead"]


def _refined(distinct: DataFrame, totals: dict[str, Column], block_turns: int) -> DataFrame:
    """The nodes in the rows of ``distinct`` blocks, with ``totals`` (aggregates by name of the column they are of).

    A block that alone follows its prefix has one node per turn and its own totals; blocks that branch are compared
    turn by turn.
    """
    at = F.sequence(F.lit(0), F.size("a") - 1)
    turn = F.transform(
        at,
        lambda i: F.struct(
            _key(F.get("a", i), F.get("b", i)).alias("key"),
            F.when(i == 0, F.col("start")).otherwise(_key(F.get("a", i - 1), F.get("b", i - 1))).alias("parent"),
            (F.col("k") * block_turns + i + 1).alias("depth"),
            F.get("bytes", i).alias("bytes"),
            F.get("ahead", i).alias("ahead"),
        ),
    )
    nodes = distinct.select("branches", *totals, F.inline(turn))
    straight = nodes.where("NOT branches").select(*_NODE, *totals)
    compared = nodes.where("branches").groupBy(*_NODE).agg(*[total.alias(name) for name, total in totals.items()])
    return straight.unionAll(compared)


def _joined_ids(members: DataFrame, scratch: Scratch) -> DataFrame:
    """SHA-256 per ``key`` of its conversations' ids in decimal, ascending, joined by commas (``members``: key, conv).

    Many tasks write the ids out in runs; hashing has to pass over a node's runs in order.
    """

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            key = np.asarray(batch.column("key").dictionary_encode().indices) if batch.num_rows else np.zeros(0)
            edges = np.flatnonzero(np.diff(key, prepend=-1))
            conv = batch.column("conv").to_pylist()
            cuts = [
                (i, min(i + _RUN_IDS, b))
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(conv)], strict=True)
                for i in range(a, b, _RUN_IDS)
            ]
            at = pa.array([a for a, _ in cuts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(at),
                    batch.column("conv").take(at),
                    pa.array([",".join(map(str, conv[a:b])).encode() for a, b in cuts], pa.binary()),
                ],
                names=["key", "first", "ids"],
            )

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, state = None, None

        def out(found: list):
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.string()), pa.array([d for _, d in found], pa.string())],
                names=["key", "ends_sha256"],
            )

        for batch in batches:
            found = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids"), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        found.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.as_py())
            yield out(found)
        if key is not None:
            yield out([(key, state.hexdigest())])

    n = partitions(members.sparkSession)
    runs = members.repartitionByRange(n, "key", "conv").sortWithinPartitions("key", "conv").select("key", "conv")
    runs = scratch.save(runs.mapInArrow(write, "key string, first long, ids binary"), "id_runs")
    return runs.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(
        digest, "key string, ends_sha256 string"
    )


def trie(turns: DataFrame, convs: DataFrame, scratch: Scratch, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included.

    ``turns`` (a written table) has ``conv``, ``depth`` (1, 2, ... without gaps), ``digest`` and ``bytes``; ``convs`` has one
    row per conversation, ``conv`` and ``turns``. Columns: ``conv_id`` (smallest member; with ``depth`` it names the
    node), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    Without conversations there are no rows. Prefixes are told apart by 128 bits of hash.
    """
    root_key = _key(F.lit(0).cast("long"), F.lit(0).cast("long"))
    blocks = _blocks(turns, scratch, block_turns)
    row = F.struct("k", "start", "a", "b", "bytes", "ahead")
    distinct = blocks.groupBy("end").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.first(row).alias("row"))
    distinct = scratch.save(distinct.select("end", "n", "conv", "row.*"), "distinct")
    follow = distinct.groupBy("start").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    follow = scratch.save(follow.withColumn("branches", F.lit(True)), "branches")
    distinct = scratch.save(Lookup(follow, "start", "rows").attach(distinct, F.col("start"), {"branches": False}), "distinct_marked")

    # Which conversation owns which nodes.
    owners = _refined(distinct, {"n": F.sum("n"), "conv": F.min("conv")}, block_turns)
    owners = scratch.save(owners, "owners")
    kids = scratch.save(owners.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    nodes = scratch.save(owners.join(kids, "key", "left"), "nodes")
    own = nodes.groupBy("conv").agg(
        F.sum("bytes").alias("owned"),
        F.count(F.when(F.col("n_children").isNull(), 1)).alias("leaves"),
        F.min(F.struct("depth", "parent")).alias("first"),
    )
    own = scratch.save(own.select("conv", "owned", "leaves", F.col("first.depth").alias("since"), F.col("first.parent").alias("above")), "own_nodes")
    least = convs.agg(F.min("conv")).first()[0]
    inner = nodes.where("n_children IS NOT NULL").select("key", F.col("conv").alias("parent_conv"), F.col("n_children").alias("rows"))
    own = Lookup(scratch.save(inner, "inner"), "key", "rows").attach(own, F.col("above"), {"parent_conv": least}).drop("above")
    paths = blocks.groupBy("conv").agg(
        F.max(F.element_at("ahead", -1) + F.element_at("bytes", -1)).alias("total"), F.count(F.lit(1)).alias("rows")
    )
    none = F.lit(0).cast("long")
    stats = convs.select("conv").join(paths, "conv", "left").join(own, "conv", "left")
    stats = scratch.save(
        stats.select(
            "conv",
            F.coalesce("rows", none).alias("rows"),
            F.coalesce("total", none).alias("total"),
            F.coalesce("owned", none).alias("owned"),
            F.coalesce("leaves", none).alias("leaves"),
            "since",
            "parent_conv",
        ),
        "stats",
    )

    # What members bring, summed along the same blocks.
    brought = {c: None for c in ("total", "owned", "leaves", "since", "parent_conv")}
    met = Lookup(stats, "conv", "rows").attach(blocks.select("conv", "end"), F.col("conv"), brought)
    owner = F.struct("conv", (F.col("total") - F.col("owned")).alias("before"), "since", "parent_conv")
    sums = met.groupBy("end").agg(
        *[F.sum(c).alias(c) for c in ("total", "owned", "leaves")], F.min(owner).alias("owner")
    )
    totals = {c: F.sum(c) for c in ("n", "total", "owned", "leaves")} | {"owner": F.min("owner")}
    found = _refined(distinct.drop("conv").join(sums, "end"), totals, block_turns)
    conv, ahead = F.col("owner.conv"), F.col("ahead")
    saved = F.col("total") - F.col("n") * ahead - (F.col("owned") + F.col("owner.before") - ahead)
    found = found.select(
        "key",
        conv.alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("owner.since"), F.col("owner.parent_conv")).otherwise(conv).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
    )
    root = stats.agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("total", "owned", "leaves")]
    ).where("n > 0")
    root = root.select(
        root_key,
        "conv",
        F.lit(0).cast("long"),
        F.lit(None).cast("long"),
        "n",
        F.greatest("leaves", F.lit(1)),  # without any turn the root itself has no children
        F.col("total") - F.col("owned"),
    )
    ends = convs.where("turns > 0").select("conv", F.floor((F.col("turns") - 1) / block_turns).alias("k"))
    ends = ends.join(blocks.select("conv", "k", "end"), ["conv", "k"]).select(F.col("end").alias("key"), "conv")
    ends = ends.unionAll(convs.where("turns = 0").select(root_key, "conv"))
    digests = _joined_ids(scratch.save(ends, "ends"), scratch)
    all_nodes = found.unionAll(root).join(kids, "key", "left").join(digests, "key", "left")
    return all_nodes.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", none).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """:func:`trie` of the conversations that :func:`rebuilt` makes of ``conversations`` (``conv_id``, ``turn``, ``role``,
    ``text``).

    Turns without ``conv_id`` belong to no conversation. A null turn comes first, equal turns (repeated rows too)
    follow each other in the order of their digests; a null role or text is empty. Other columns are not read. A
    conversation may hold any share of all turns: its digests, its rows and its joins are spread.
    """
    scratch = Scratch(conversations.sparkSession)
    turns, convs = rebuilt(ordered_turns(conversations, scratch), scratch)
    return trie(turns, convs, scratch, block_turns)
