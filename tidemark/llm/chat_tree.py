"""Chat formatting as prefix trees: shared turns once, depth first, with positions and ancestor attention intervals."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.byte_bpe import ByteBPE
from tidemark.llm.common import save, shuffle_width, with_missing
from tidemark.llm.packing import tokenizer_files

#: A turn is OPEN role NEWLINE text CLOSE. Inside role and text these strings, and backslashes, are escaped.
OPEN, CLOSE = "<s>", "</s>"
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|<\|[a-z_]+\|>")
#: Nodes whose running total is taken in one window.
RUN_BITS = 10


def escape(text: str) -> str:
    """A backslash doubles; control strings get one after their first character, so none is left whole."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail; the body is what the loss mask covers in assistant turns."""
    return OPEN + escape(role).replace("\n", "\\\n") + "\n", escape(text), CLOSE


def parse_turn(formatted: str) -> tuple[str, str]:
    inner = formatted[len(OPEN) : -len(CLOSE)]
    cut = re.match(r"(?:\\.|[^\\\n])*\n", inner, re.S).end()
    return unescape(inner[: cut - 1]), unescape(inner[cut:])


def _key(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return h.digest()


def _nodes(batches):
    """Turns in order of (conv_id, turn) to nodes: a turn's node is the hash of its conversation up to it."""
    conv, depth, node, root = None, 0, b"", b""
    first = True
    for b in batches:
        rows = []
        for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
            if first or c != conv:
                first, conv, depth, node = False, c, 0, b""
            parent = node
            node = _key(parent, (role or "").encode(), (text or "").encode())
            root = node if depth == 0 else root
            rows.append((c, depth, node, root, role or "", text or ""))
            depth += 1
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()))], names=["conv_id", "depth", "node", "root", "role", "text"])


def _paths(batches):
    """(conv_id, leaf, path) of the rows of _nodes: the path holds eight bytes per turn, so paths sort depth first."""
    conv, leaf, path, some = None, b"", [], False

    def row():
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([leaf], pa.binary()), pa.array([b"".join(path)], pa.binary())], names=["conv_id", "leaf", "path"])

    for b in batches:
        for c, node in zip(b.column("conv_id").to_pylist(), b.column("node").to_pylist()):
            if some and c != conv:
                yield row()
                path = []
            some, conv, leaf = True, c, node
            path.append(node[:8])
    if some:
        yield row()


def _encode(files):
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("depth", pa.int32()), ("ids", pa.binary()), ("length", pa.int64()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("owner", pa.int64())])

    def run(batches):
        bpe = ByteBPE.at(*files)
        for b in batches:
            rows = []
            for node, root, depth, role, text, owner in zip(*(b.column(k).to_pylist() for k in ("node", "root", "depth", "role", "text", "owner"))):
                head, body, tail = (bpe.ids(x) for x in format_turn(role, text))
                a, z = len(head) // 4, (len(head) + len(body)) // 4
                rows.append((node, root, depth, head + body + tail, z + len(tail) // 4, *((a, z) if role == "assistant" else (a, a)), owner))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [()] * 8, schema)], schema=schema)

    return run


def _layout(batches):
    """Along each leaf's path: position and merged ancestor intervals of the nodes that this leaf owns."""
    leaf, at, held = None, 0, []
    interval = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for b in batches:
        out = []
        for rank, node, offset, length, owner in zip(*(b.column(k).to_pylist() for k in ("rank", "node", "offset", "length", "owner"))):
            if rank != leaf:
                leaf, at, held = rank, 0, []
            if owner == rank:
                out.append((node, at, [{"start": s, "end": e} for s, e in held]))
            if held and held[-1][1] == offset:
                held[-1] = (held[-1][0], offset + length)
            else:
                held.append((offset, offset + length))
            at += length
        cols = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(interval))], names=["node", "position", "attends"])


def chat_trees(conversations: DataFrame, files: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, paths, leaves) of conversations (conv_id, turn, role, text).

    nodes: tree (its first turn's node), node, depth, ids (token ids of the turn,
    32-bit little-endian), offset (place in the tree's sequence, depth first),
    length, position (tokens before it in its conversation), attends (intervals
    of the sequence that its ancestors fill), loss_from and loss_to (tokens of
    the turn under the loss mask). Every turn that conversations share from their
    beginning is there once. paths: leaf, depth, node. leaves: conv_id, leaf.

    Turns are read in order of (conv_id, turn), as a stream; trees are never
    gathered: paths are sorted over the cluster, a node belongs to its first leaf,
    and offsets are running totals by runs of leaves. Ties of turn go by role and
    text, null last; null role and text are empty. Rows without conv_id are one
    conversation.
    """
    spark, files = conversations.sparkSession, files or tokenizer_files()
    rows = with_missing(conversations, conv_id="long", turn="long", role="string", text="string")
    order = [F.asc_nulls_last(c) for c in ("turn", "role", "text")]
    turns = rows.repartition(shuffle_width(spark), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)
    turns = save(turns.mapInArrow(_nodes, "conv_id long, depth int, node binary, root binary, role string, text string"), "turns")
    again = turns.select("conv_id", "depth", "node").repartition(shuffle_width(spark), "conv_id").sortWithinPartitions("conv_id", "depth")
    leaves = save(again.mapInArrow(_paths, "conv_id long, leaf binary, path binary"), "leaves")
    # one conversation stands for all that end in the same leaf
    distinct = leaves.groupBy("leaf").agg(F.min(F.coalesce("conv_id", F.lit(-(1 << 63)))).alias("conv"), F.first("path").alias("path"))
    ranked = save(distinct.repartitionByRange(shuffle_width(spark), "path").sortWithinPartitions("path").select("leaf", "conv", F.monotonically_increasing_id().alias("rank")), "ranks")
    named = turns.withColumn("conv", F.coalesce("conv_id", F.lit(-(1 << 63))))
    paths = save(named.join(ranked, "conv").select("rank", "leaf", "depth", "node"), "paths")
    owners = paths.groupBy("node").agg(F.min("rank").alias("owner"))
    owned = paths.join(owners, "node").where("rank = owner").select("node", "owner")
    texts = named.join(ranked.select("conv", F.col("rank").alias("owner")), "conv").join(owned, ["node", "owner"]).select("node", "root", "depth", "role", "text", "owner")
    nodes = save(texts.mapInArrow(_encode(files), "node binary, root binary, depth int, ids binary, length long, loss_from long, loss_to long, owner long"), "nodes")
    slim = nodes.select("node", "root", "depth", "length", "owner").withColumn("run", F.shiftright("owner", RUN_BITS))
    total = slim.groupBy("root", "run").agg(F.sum("length").alias("t"))
    before = total.select("root", "run", (F.sum("t").over(W.partitionBy("root").orderBy("run")) - F.col("t")).alias("before"))
    inside = F.sum("length").over(W.partitionBy("root", "run").orderBy("owner", "depth").rowsBetween(W.unboundedPreceding, 0)) - F.col("length")
    placed = save(slim.withColumn("inside", inside).join(before, ["root", "run"]).select("node", "owner", "length", (F.col("before") + F.col("inside")).alias("offset")), "offsets")
    along = paths.select("rank", "depth", "node").join(placed, "node").repartition(shuffle_width(spark), "rank").sortWithinPartitions("rank", "depth")
    laid = along.mapInArrow(_layout, "node binary, position long, attends array<struct<start: bigint, end: bigint>>")
    full = nodes.drop("owner").join(placed.select("node", "offset"), "node").join(laid, "node").withColumnRenamed("root", "tree")
    return full, paths.select("leaf", "depth", "node"), leaves.select("conv_id", "leaf")


def _read(files):
    """Decode each leaf's turns in order and digest them."""
    schema = pa.schema([("leaf", pa.binary()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        from tokenizers import Tokenizer

        decode = Tokenizer.from_file(files[0]).decode
        text = lambda ids: decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        leaf = None
        state = None

        def row():
            n, turns, chars, loss, formatted = state
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((leaf, n, turns.hexdigest(), chars, loss.hexdigest(), formatted), schema)], schema=schema)

        at = 0
        for b in batches:
            for key, ids, a, z, position, attends in zip(*(b.column(k).to_pylist() for k in ("leaf", "ids", "loss_from", "loss_to", "position", "attends"))):
                if key != leaf:
                    if state:
                        yield row()
                    leaf, state, at = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], 0
                if position != at or sum(x["end"] - x["start"] for x in attends) != at:
                    raise ValueError("positions or attention intervals don't fit the turns before")
                at += len(ids) // 4
                formatted = text(ids)
                role, said = parse_turn(formatted)
                masked = unescape(text(ids[4 * a : 4 * z]))
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(formatted)
        if state:
            yield row()

    return run


def read_back(nodes: DataFrame, paths: DataFrame, leaves: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the token ids of the trees' nodes.

    Conversations that end in the same leaf are read once.
    """
    spark, files = nodes.sparkSession, files or tokenizer_files()
    along = paths.join(nodes.select("node", "ids", "loss_from", "loss_to", "position", "attends"), "node")
    along = along.repartition(shuffle_width(spark), "leaf").sortWithinPartitions("leaf", "depth")
    digests = along.mapInArrow(_read(files), "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return leaves.join(save(digests, "digests"), "leaf").drop("leaf")
