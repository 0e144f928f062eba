"""Token counts that follow edits: a segment tree of pre-tokens per document.

Method
  1. A text is split into pre-tokens by the tokenizer's pattern; each is encoded on its own (counts of frequent ones are remembered, with a bound). Their lengths and counts are
     the leaves' entries of a segment tree whose inner nodes hold sums of characters, tokens and entries.
  2. An edit (start, end, text) finds its place by the sums. Splitting starts again before it, at a boundary whose pre-tokens can't have seen the edit: all white space
     before the edit and ``LOOK`` characters are context. It goes on in the new text until a boundary falls on an old one after the edit; from there on
     old and new agree, as the pattern looks only ahead. Only the pre-tokens between are encoded; the leaves they fall in, which hold the text, and the sums on the path to the root change.
     So an edit takes time by its own length and the depth of the tree, not by the text's length. A part of the tree that has become uneven is built anew, so the depth stays in proportion to the
     logarithm of the leaves, wherever the edits are; insertions at one place are one edit.
  3. The document's count is the root's sum. It equals that of encoding the new text from scratch.

Edits are code-point spans of the original text, not overlapping, applied from right to left (of edits at one place, the later in the list first); ends beyond the text are cut.
Null and empty texts have 0 tokens; a null list has no edits; a null replacement is empty. The vocabulary is a parameter: a file of ranks that the driver reads and sends to the executors, at most
``VOCABULARY_BYTES`` long. Invalid UTF-8 is read with replacement characters. Repeated rows count each on its own; extra columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import lean

# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 64 << 20
#: Characters after its end that may decide where a pre-token ends, white space apart.
LOOK = 3
#: Characters after an edit that are split anew at first; four times as many if no old boundary is met in them.
WINDOW = 64
#: Pre-tokens of a leaf; one of twice as many is split.
LEAF = 128
REMEMBERED = 500_000


class _Known(dict):
    """Token counts of pre-tokens; an unknown one is encoded, and remembered if it is short, within a bound."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece.encode("utf-8", "replace")))
        if len(piece) <= 32:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of pre-tokens."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known = _Known(self.bpe._core_bpe.encode_single_piece)
        self.count = self.known.__getitem__


class _Node:
    """Of a leaf: its text, and arrays of lengths and counts; of an inner node: two children. Sums: chars, tokens, entries."""

    __slots__ = ("left", "right", "text", "lens", "toks", "chars", "tokens", "entries", "leaves")

    def __init__(self, text=None, lens=None, toks=None, left=None, right=None):
        self.left, self.right, self.text, self.lens, self.toks = left, right, text, lens, toks
        self.update()

    def update(self):
        if self.left is None:
            self.chars, self.tokens, self.entries, self.leaves = int(self.lens.sum()), int(self.toks.sum()), len(self.lens), 1
        else:
            a, b = self.left, self.right
            self.chars, self.tokens, self.entries, self.leaves = a.chars + b.chars, a.tokens + b.tokens, a.entries + b.entries, a.leaves + b.leaves

    def become(self, other: _Node):
        self.left, self.right, self.text, self.lens, self.toks = other.left, other.right, other.text, other.lens, other.toks
        self.update()

    def even(self) -> bool:
        """Whether neither side has much more than half of the leaves."""
        return self.left is None or 10 * max(self.left.leaves, self.right.leaves) <= 7 * self.leaves + 10

    @staticmethod
    def over(leaves: list[_Node]) -> _Node:
        """A tree of these leaves."""
        while len(leaves) > 1:
            leaves = [_Node(left=leaves[i], right=leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0]

    def parts(self) -> list[_Node]:
        """The leaves in order."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                out.append(node)
            else:
                todo += (node.right, node.left)
        return out

    @staticmethod
    def build(text: str, lens, toks) -> _Node:
        """A tree of leaves that each hold their part of the text."""
        ends = np.concatenate([[0], np.cumsum(lens)])

        def part(i: int, j: int) -> _Node:
            if j - i <= LEAF:
                return _Node(text[ends[i] : ends[j]], lens[i:j], toks[i:j])
            half = i + (j - i) // 2
            return _Node(left=part(i, half), right=part(half, j))

        return part(0, len(lens))

    def replace(self, i: int, j: int, text: str, lens, toks):
        """Entries i to j (exclusive) become these."""
        if self.left is None:
            a, b = int(self.lens[:i].sum()), int(self.lens[:j].sum())
            self.text = self.text[:a] + text + self.text[b:]
            self.lens = np.concatenate([self.lens[:i], lens, self.lens[j:]])
            self.toks = np.concatenate([self.toks[:i], toks, self.toks[j:]])
            if len(self.lens) > 2 * LEAF:
                self.become(_Node.build(self.text, self.lens, self.toks))
        else:
            k = self.left.entries
            none = lens[:0]
            if i <= k:
                self.left.replace(i, min(j, k), text, lens, toks)
            if j > k or i > k:
                at, add = (0, ("", none, none)) if i <= k else (i - k, (text, lens, toks))
                self.right.replace(at, j - k, *add)
        self.update()

    def part(self, a: int, b: int) -> str:
        """Characters a to b (exclusive), from the leaves that hold them."""
        out, todo = [], [(self, a, b)]
        while todo:
            node, a, b = todo.pop()
            if a >= b:
                continue
            if node.left is None:
                out.append(node.text[max(0, a) : b])
            else:
                k = node.left.chars
                todo.append((node.right, max(0, a - k), b - k))
                todo.append((node.left, a, min(b, k)))
        return "".join(out)

    def before(self, pos: int) -> tuple[int, int]:
        """(entry, its start): the last entry that starts at or before ``pos``; the end if there is none after."""
        node, entry, start = self, 0, 0
        while node.left is not None:
            if pos < start + node.left.chars or not node.right.entries:
                node = node.left
            else:
                entry, start, node = entry + node.left.entries, start + node.left.chars, node.right
        ends = start + np.cumsum(node.lens)
        i = int(np.searchsorted(ends, pos, "right"))
        return entry + i, start + (int(node.lens[:i].sum()) if i else 0)


class TokenTree:
    """The pre-tokens of one text; ``tokens`` is its count, ``touched`` the pre-tokens that edits have encoded. The leaves hold the text, so an edit copies what is around it alone."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.touched = counter, 0
        pieces = counter.pattern.findall(text)
        self.root = _Node.build(text, np.fromiter(map(len, pieces), np.int64, len(pieces)), np.fromiter(map(counter.count, pieces), np.int64, len(pieces)))

    @property
    def tokens(self) -> int:
        return self.root.tokens

    @property
    def text(self) -> str:
        return self.root.part(0, self.root.chars)

    def _context(self, start: int) -> int:
        """Where the white space before ``start`` begins."""
        size = 64
        while start:
            before = self.root.part(max(0, start - size), start)
            solid = before.rstrip()
            if solid or len(before) == start:
                return start - len(before) + len(solid)
            size *= 4
        return 0

    def edit(self, start: int, end: int, new: str) -> None:
        root, n = self.root, self.root.chars
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        # the boundary to start from: all pre-tokens before it end LOOK characters before the context
        first, at = root.before(max(0, self._context(start) - LOOK))
        total = root.entries
        last, last_at = root.before(end)
        if last < total and last_at < end:  # within a pre-token: its end is the first boundary after the edit
            last_at += next(self._lengths(last))
            last += 1
        head = root.part(at, start) + new
        shift = len(head) - end  # from places of the old text, after the edit, to those of the piece that is split anew
        span = WINDOW
        while True:
            stop = min(n, max(end, last_at) + span)
            piece = head + root.part(end, stop)
            lens, toks, pos, old, old_at, lengths = [], [], 0, last, last_at, self._lengths(last)
            met = False
            for m in self.counter.pattern.finditer(piece):
                while old < total and old_at + shift < pos:
                    old_at += next(lengths)
                    old += 1
                met = pos >= len(head) and old_at + shift == pos
                if met or stop < n and m.end() > len(piece) - LOOK:  # the rest of the text may have a say
                    break
                lens.append(m.end() - pos)
                toks.append(self.counter.count(m[0]))
                pos = m.end()
            else:
                if stop == n:
                    old, met = total, True
            if met:
                break
            span *= 4
        self.touched += len(lens)
        root.replace(first, old, piece[:pos], np.array(lens, np.int64), np.array(toks, np.int64))
        self._even_out(first)

    def _lengths(self, entry: int):
        """Lengths of the entries from this one on, leaf by leaf."""
        later, node = [], self.root
        while node.left is not None:
            if entry < node.left.entries:
                later.append(node.right)
                node = node.left
            else:
                entry -= node.left.entries
                node = node.right
        yield from node.lens[entry:].tolist()
        while later:
            node = later.pop()
            if node.left is None:
                yield from node.lens.tolist()
            else:
                later += (node.right, node.left)

    def _even_out(self, entry: int) -> None:
        """Builds the highest uneven node on the way to an entry anew: a node becomes uneven only by changes in proportion to it, so this costs each edit the tree's depth on average."""
        node = self.root
        while node.left is not None:
            if not node.even():
                kept = [leaf for leaf in node.parts() if leaf.entries]
                if kept:
                    node.become(_Node.over(kept))
                return
            if entry < node.left.entries:
                node = node.left
            else:
                entry -= node.left.entries
                node = node.right


def vocabulary_bytes(docs: DataFrame, vocabulary: str):
    """The file of ranks as a broadcast variable."""
    with open(vocabulary, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has more than {VOCABULARY_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(data)


_SCHEMA = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_encoded long"


def merged(edits: list[tuple[int, int, str | None]]) -> list[tuple[int, int, str]]:
    """The edits from left to right, with insertions at one place, and the edit that begins there, as one."""
    out: list[list] = []
    for start, end, new in sorted(edits, key=lambda e: e[0]):
        if out and out[-1][0] == out[-1][1] == start:
            out[-1][1] = end
            out[-1][2].append(new or "")
        else:
            out.append([start, end, [new or ""]])
    return [(start, end, "".join(new)) for start, end, new in out]


def _edited(counter: Counter, rows):
    """Rows of the schema for (doc_id, text, edits as (start, end, text))."""
    for doc_id, text, edits in rows:
        tree = TokenTree(text or "", counter)
        before = tree.tokens
        for start, end, new in reversed(merged(edits)):
            tree.edit(start, end, new)
        yield doc_id, before, len(edits), tree.tokens, tree.touched


def _decoded(raw: bytes | None) -> str:
    return "" if raw is None else raw.decode("utf-8", "replace")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[c.split()[0] for c in _SCHEMA.split(", ")])


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_encoded): a row per row of ``docs`` (doc_id long, text string, edits array<struct<start, end, text>>).

    ``n_tokens`` counts the text, ``n_tokens_edited`` the text after its edits; ``n_encoded`` is the number of pre-tokens that the edits had encoded again.
    """
    ranks = vocabulary_bytes(docs, vocabulary)

    def run(batches):
        counter = Counter(ranks.value)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "edits"))
            rows = list(_edited(counter, ((i, _decoded(t), [(e["start"], e["end"], e["text"]) for e in edits or ()]) for i, t, edits in zip(*columns, strict=True))))
            if rows:
                yield _table(rows)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), "edits").mapInArrow(lean(run), _SCHEMA)


def count_masked(docs: DataFrame, digits: int = 4, mask: str = "#", vocabulary: str = VOCABULARY) -> DataFrame:
    """The same for ``docs`` (doc_id long, text string) with the edits that turn each run of at least so many digits into the mask (telephone and card numbers, keys)."""
    ranks = vocabulary_bytes(docs, vocabulary)
    find = regex.compile(rf"[0-9]{{{digits},}}+")

    def run(batches):
        counter = Counter(ranks.value)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), map(_decoded, batch.column("text").to_pylist())
            rows = list(_edited(counter, ((i, t, [(m.start(), m.end(), mask) for m in find.finditer(t)]) for i, t in zip(ids, texts, strict=True))))
            if rows:
                yield _table(rows)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), _SCHEMA)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_masked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
