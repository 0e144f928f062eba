"""Chat formatting: conversations as prefix trees of turns, packed into token sequences that hold what is shared once.

Method
  1. *Template.* A turn is ``TURN role TEXT text END``. The three marks are ids beyond the vocabulary and the strings of ``MARKS`` in print. A control string in a role or text (``CONTROL``: the marks, and those
     of common models) gets a backslash behind its first character, one more if it has some already, so that no control string is left and taking one backslash away restores the text.
  2. *Turns.* Rows are range-partitioned by (conv_id, turn), so that a conversation of any length is many tasks; roles and texts are tokenised on their own, and each turn gets a digest.
  3. *Paths.* Runs of up to ``RUN`` turns are packed before they meet in one row per conversation: its path, 16 bytes a turn. Equal paths are one.
  4. *Prefix tree.* Paths are range-partitioned in their order, which is depth-first; each path adds the turns beyond what it shares with the one before. Packs hold up to ``PACK`` tokens (or one longer path); a
     new pack starts with its first path in full, so a tree below a common first turn is many packs.
  5. *Attention.* A turn's tokens see the turn itself up to themselves, and its ancestors: ``attends`` has their places in the pack as merged intervals, and position ids go on from the parent's.
  6. *Pages.* A pack is stored as pages of up to ``PAGE_TURNS`` turns and ``PAGE`` tokens (or one longer turn).

`read_back` reads the packs depth-first with one running digest per open turn, so shared turns are read once, too.

A null text or role is empty. Turns stand by turn, null last; those of equal turn by a digest of role and text. A null conv_id is a conversation. Repeated rows are turns of their own. Extra columns are
ignored; an empty table has no packs. Invalid UTF-8 is read with replacement characters. A text is tokenised whole, however long; a conversation's path is one value, and so is a page.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import lean, written
from veritally.llm.tokens import VOCABULARY, Counter, vocabulary_bytes

MARKS = ("<|turn|>", "<|text|>", "<|end|>")
#: Strings that templates of common models give a meaning, and the marks; none is within another's beginning.
CONTROL = (*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
RUN, PACK, PAGE, PAGE_TURNS = 1024, 32_768, 16_384, 256
#: A path with more than one in so many conversations is sent to all tasks: so many paths at most.
COMMON = 10_000
_DIGEST = 16

_rest = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN = re.compile(rf"([<\[])(\\*)({_rest})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_rest})")


def escape(text: str) -> str:
    """Without control strings; `unescape` restores the text."""
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _turns(conversations: DataFrame) -> DataFrame:
    """Role and text of each turn, in order over all machines."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_last(), "tie"]
    return rows.withColumn("tie", F.sha2(F.concat("role", F.lit("\n"), "text").cast("binary"), 256)).repartitionByRange(*order).sortWithinPartitions(*order)


def tokenised(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row, conv_id, digest, tokens, first, last): the tokens of each turn, and which of them are under the loss mask (an assistant's text, marks excluded). ``row`` ascends by conversation and turn."""
    ranks = vocabulary_bytes(conversations, vocabulary)

    def run(batches):
        bpe = Counter(ranks.value).bpe
        mark = [bpe.n_vocab + k for k in range(3)]
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for role, text in zip(*(batch.column(c).to_pylist() for c in ("role", "text")), strict=True):
                role, text = role.decode("utf-8", "replace"), text.decode("utf-8", "replace")
                head, body = bpe.encode_ordinary(escape(role)), bpe.encode_ordinary(escape(text))
                first = len(head) + 2
                loss = (first, first + len(body)) if role == "assistant" else (0, 0)
                digest = hashlib.sha256(f"{len(role)}\n{role}\n{text}".encode()).digest()[:_DIGEST]
                out.append((row, digest, [mark[0], *head, mark[1], *body, mark[2]], *loss))
                row += 1
            if out:
                rows, digests, tokens, first, last = zip(*out, strict=True)
                columns = [pa.array(rows, pa.int64()), batch.column("conv_id"), pa.array(digests, pa.binary()), pa.array(tokens, pa.list_(pa.int32())), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "conv_id", "digest", "tokens", "first", "last"])

    binary = [F.col(c).cast("binary").alias(c) for c in ("role", "text")]
    return _turns(conversations).select("conv_id", *binary).mapInArrow(lean(run), "row long, conv_id long, digest binary, tokens array<int>, first int, last int")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, key, path, sizes, runs): per conversation the digests and token counts of its turns, a digest of the path, and the rows of its turns as runs (first, number)."""

    def run(batches):
        for batch in batches:
            conv, row = batch.column("conv_id").to_pylist(), batch.column("row").to_numpy()
            digests, sizes = batch.column("digest").to_pylist(), batch.column("n").to_numpy().astype("<i4")
            cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1] or row[i] != row[i - 1] + 1), len(conv)]
            spans = [(i, min(i + RUN, b)) for a, b in pairwise(cuts) for i in range(a, b, RUN)]
            if spans:
                columns = [[conv[a] for a, _ in spans], [int(row[a]) for a, _ in spans], [b - a for a, b in spans], [b"".join(digests[a:b]) for a, b in spans], [sizes[a:b].tobytes() for a, b in spans]]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "first", "n", "digests", "sizes"])

    runs = turns.select("row", "conv_id", "digest", F.size("tokens").alias("n")).mapInArrow(lean(run), "conv_id long, first long, n long, digests binary, sizes binary")
    got = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", "n", "digests", "sizes"))).alias("runs"))
    joined = lambda c: F.aggregate("runs", F.lit(bytearray()), lambda a, r: F.concat(a, r[c]))
    got = got.select("conv_id", joined("digests").alias("path"), joined("sizes").alias("sizes"), F.transform("runs", lambda r: F.struct(r["first"], r["n"])).alias("runs"))
    return got.withColumn("key", F.sha2("path", 256))


class _Pack:
    """The open pack of a task: its tokens so far, and the path that was added last as (node, start, end, position after it, intervals it lets its children see)."""

    def __init__(self):
        self.pack, self.nodes, self.used, self.page, self.page_from, self.page_turns = -1, 0, 0, 0, 0, 0
        self.open: list[tuple] = []
        self.path = b""

    def shared(self, path: bytes) -> int:
        """How many turns ``path`` has in common with the last one."""
        n = min(len(path), len(self.path))
        a, b = (np.frombuffer(x, np.uint8, n).reshape(-1, _DIGEST) for x in (path, self.path))
        other = np.flatnonzero((a != b).any(axis=1))
        return int(other[0]) if len(other) else n // _DIGEST

    def add(self, path: bytes, sizes: list[int], rows: list[int], key: str, copies: int, pack_tokens: int):
        """Yields the turns that the path adds."""
        keep = self.shared(path) if self.nodes else 0
        if not self.nodes or self.used + sum(sizes[keep:]) > pack_tokens:
            self.pack, self.nodes, self.used, self.page, self.page_from, self.page_turns, self.open, keep = self.pack + 1, 0, 0, 0, 0, 0, [], 0
        self.path = path
        del self.open[keep:]
        for depth in range(keep, len(sizes)):
            parent = self.open[-1] if self.open else (-1, 0, 0, 0, ())
            if self.page_turns and (self.page_turns == PAGE_TURNS or self.used + sizes[depth] - self.page_from > PAGE):
                self.page, self.page_from, self.page_turns = self.page + 1, self.used, 0
            start, end, seen = self.used, self.used + sizes[depth], parent[4]
            last = depth == len(sizes) - 1
            yield rows[depth], self.pack, self.page, self.nodes, parent[0], depth, start, end, parent[3], seen, key if last else None, copies if last else 0
            onward = (*seen[:-1], (seen[-1][0], end)) if seen and seen[-1][1] == start else (*seen, (start, end))
            self.open.append((self.nodes, start, end, parent[3] + sizes[depth], onward))
            self.nodes, self.used, self.page_turns = self.nodes + 1, end, self.page_turns + 1


_NODES = "row long, pack long, page int, node long, parent long, depth long, start long, end long, position long, attends array<struct<start:long,end:long>>, key string, copies long"


def tree(conversations: DataFrame, pack_tokens: int = PACK) -> DataFrame:
    """The turns of all packs (`_NODES`), each shared one once per pack; ``key`` stands where a path ends, with how many conversations have it."""
    distinct = conversations.groupBy("key").agg(F.count("*").alias("copies"), F.min_by(F.struct("path", "sizes", "runs"), F.col("runs")[0]["first"]).alias("x")).select("key", "copies", "x.*")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6, kind, pa.string(), pa.int64()]
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", _NODES)]

    def run(batches):
        state, base = _Pack(), TaskContext.get().partitionId() << 32
        hand = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            out = []
            for got in batch.to_pylist():
                rows = [r["first"] + i for r in got["runs"] for i in range(r["n"])]
                for node in state.add(got["path"], np.frombuffer(got["sizes"], "<i4").tolist(), rows, got["key"], got["copies"], pack_tokens):
                    out.append((node[0], base + node[1], *node[2:9], [{"start": a, "end": b} for a, b in node[9]], *node[10:]))
                    if len(out) >= 2000:
                        yield hand(out)
                        out = []
            if out:
                yield hand(out)

    ordered = distinct.repartitionByRange("path", "key").sortWithinPartitions("path", "key")
    return ordered.select("path", "sizes", "runs", "key", "copies").mapInArrow(lean(run), _NODES)


def packs(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """(pack, page, tokens, positions, loss, nodes): the packed sequences. ``nodes`` has a turn's node, parent (-1: none), depth, start and end in the pack, attends, and key where a path ends."""
    held = nodes.join(turns.select("row", "tokens", "first", "last"), "row")
    turn = F.struct("node", "parent", "depth", "start", "end", "position", "attends", "key", "tokens", "first", "last")
    got = held.groupBy("pack", "page").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    flat = lambda f: F.flatten(F.transform("t", f))
    return got.select(
        "pack",
        "page",
        flat(lambda t: t["tokens"]).alias("tokens"),
        flat(lambda t: F.transform(t["tokens"], lambda _, i: t["position"] + i)).alias("positions"),
        flat(lambda t: F.transform(t["tokens"], lambda _, i: (i >= t["first"]) & (i < t["last"]))).alias("loss"),
        F.transform("t", lambda t: F.struct(*(t[c].alias(c) for c in ("node", "parent", "depth", "start", "end", "attends", "key")))).alias("nodes"),
    )


def format_chats(conversations: DataFrame, vocabulary: str = VOCABULARY, pack_tokens: int = PACK) -> tuple[DataFrame, DataFrame]:
    """(packs, members) for ``conversations`` (conv_id long, turn long, role string, text string): `packs`, and (conv_id, key, copies), which names the node where each conversation ends."""
    turns = written(tokenised(conversations, vocabulary), "chat-turns")
    convs = written(paths(turns), "chat-paths")
    nodes = written(tree(convs, pack_tokens), "chat-nodes")
    return written(packs(nodes, turns), "chat-packs"), convs.select("conv_id", "key")


def read_back(pages: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each path that ends in the packs, from tokens, mask and tree alone."""
    ranks = vocabulary_bytes(pages, vocabulary)
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        bpe = Counter(ranks.value).bpe
        text_mark, marked = bpe.n_vocab + 1, sum(map(len, MARKS))
        said = lambda ids: bpe.decode_bytes(ids).decode()
        pack, open_ = None, []
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                if batch.column("pack")[i].as_py() != pack:
                    pack, open_ = batch.column("pack")[i].as_py(), []
                tokens, nodes = batch.column("tokens")[i].values.to_numpy().tolist(), batch.column("nodes")[i].as_py()
                loss = batch.column("loss")[i].values.to_numpy(zero_copy_only=False)
                page_at = nodes[0]["start"]
                for node in nodes:
                    own = slice(node["start"] - page_at, node["end"] - page_at)
                    ids = tokens[own]
                    cut = ids.index(text_mark)
                    role, text = said(ids[1:cut]), said(ids[cut + 1 : -1])
                    under = np.flatnonzero(loss[own]).tolist()
                    masked = [ids[k] for k in under]
                    masked = unescape(text if masked == ids[cut + 1 : -1] else said(masked))
                    turns_hash, loss_hash, n, n_loss, n_all = open_[node["depth"] - 1] if node["depth"] else (hashlib.sha256(), hashlib.sha256(), 0, 0, 0)
                    turns_hash, loss_hash = turns_hash.copy(), loss_hash.copy()
                    turns_hash.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    loss_hash.update(masked.encode())
                    state = turns_hash, loss_hash, n + 1, n_loss + len(masked), n_all + marked + len(role) + len(text)
                    open_[node["depth"] :] = [state]
                    if node["key"] is not None:
                        out.append((node["key"], state[2], turns_hash.hexdigest(), state[3], loss_hash.hexdigest(), state[4]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    inner = F.transform("nodes", lambda t: F.struct(t["depth"], t["start"], t["end"], t["key"])).alias("nodes")
    ordered = pages.select("pack", "page", "tokens", "loss", inner).repartition("pack").sortWithinPartitions("pack", "page")
    return ordered.mapInArrow(lean(run), "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def by_conversation(members: DataFrame, read: DataFrame) -> DataFrame:
    """``read`` for each conversation. Paths that more than one in ``COMMON`` conversations have are broadcast (``COMMON`` rows at most), the others joined by a shuffle."""
    copies = members.groupBy("key").agg(F.count("*").alias("copies"))
    read = written(read.join(copies, "key").withColumn("common", F.col("copies") * COMMON > members.count()), "chat-read")
    common, rare = (read.where(c).drop("common", "copies") for c in ("common", "NOT common"))
    return members.join(F.broadcast(common), "key").union(members.join(F.broadcast(common.select("key")), "key", "left_anti").join(rare, "key")).drop("key")


def op13_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    pages, members = format_chats(turns.union(planted))
    return by_conversation(members, read_back(pages))
