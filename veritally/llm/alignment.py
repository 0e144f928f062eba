"""Cross-tokenizer alignment: the smallest groups of tokens of two tokenizers that cover the same bytes.

Method
  1. *Encoding.* A is a byte-level BPE file, B a sentencepiece model; both see a space and the text (B adds the space itself). Special tokens' strings in a text are plain text.
  2. *Dangling-suffix transducer.* Its state is which side leads and the bytes of that side's last token that the other hasn't matched. The next token is always the lagging side's: it shortens the
     residual, closes the group (empty residual), or is longer and leads with its own rest. Transitions are memoised by (side, residual, token). Each step but a group's first is one link: the token
     and the leading side's last token share bytes.
  3. *Remembered stretches.* Between a solid character and white space both tokenizers end a token, whatever is around, so the residual is empty there: a text is cut at such places and
     the transducer's whole output for a stretch is remembered, within a bound. A text with unusual white space is one stretch.
  4. *Counts of linked ids.* Each document's links are packed as (pair of ids, times), summed per task before the shuffle, and counted over the corpus. The commonest pairs, ``HEAVY`` at most, are sent to
     all tasks, so that no frequent pair is a hot key; the other pairs of each document are joined by a shuffle. Both together are all links.

Null, empty and invalid UTF-8 texts, and texts of which either side's bytes differ from space and text (unknown pieces, a literal U+2581, normalised characters), have no tokens: zeros and ''.
Repeated rows and doc_ids, and rows without doc_id, are rows of their own and count each; a row's text is encoded whole. Extra columns are ignored; an empty table has no rows. The two files are
parameters, read by the driver and sent to the executors, ``FILE_BYTES`` long at most.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import lean, scratch_path, written
from veritally.llm.tokens import PATTERN

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
FILE_BYTES = 64 << 20
#: A pair of ids is one integer: A's id times WIDTH, and B's.
WIDTH = 1 << 18
#: Pairs that are sent to all tasks at most (13 bytes each).
HEAVY = 1_000_000
#: Stretches that are remembered (in each of two generations), and their longest; pairs that a task sums before it hands them on.
REMEMBERED, LONGEST, SUMMED = 200_000, 48, 2_000_000
#: Stretches of a text that are aligned together.
AT_ONCE = 20_000

def _class(*ranges: tuple[int, int]) -> str:
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


#: White space before which texts are cut: a solid run with the white space before it, or white space at the end.
_CUT = _class((0x20, 0x20), (0x09, 0x0C))
_STRETCH = regex.compile(f"[{_CUT}]*+[^{_CUT}]++|[{_CUT}]++$")
#: White space of other kinds: where it stands, tokens may reach over a cut.
_ODD = regex.compile(f"[{_class((0x0D, 0x0D), (0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))}]")
#: Letters whose classes all versions of Unicode agree on.
_PLAIN = regex.compile(f"[{_class((0, 0x24F), (0x2010, 0x2027))}]*+")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies spell bytes: printable ones stand for themselves, the others for the next code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE tokenizer from its JSON file."""

    def __init__(self, data: bytes):
        import tiktoken

        self.data, self._whole = data, None
        model = json.loads(data)["model"]
        alphabet = byte_alphabet()
        spelt = {t: bytes(alphabet[c] for c in t) for t in model["vocab"] if all(c in alphabet for c in t)}
        self.bytes = {i: spelt.get(t, t.encode()) for t, i in model["vocab"].items()}
        # merges in the order of their results' ids are ranks
        merged = ["".join(m) if not isinstance(m, str) else m.replace(" ", "", 1) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        singles = [model["vocab"][c] for c in alphabet]
        self.fast = None
        if ids == sorted(set(ids)) and (not ids or max(singles) < ids[0]):
            used = {*ids, *singles}
            ranks = {b: i for t, b in spelt.items() if (i := model["vocab"][t]) in used}
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if self.fast and _PLAIN.fullmatch(text):
            return self.fast(text)
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_str(self.data.decode())
            self._whole.encode_special_tokens = True
        return self._whole.encode(text, add_special_tokens=False).ids


class PieceBpe:
    """A sentencepiece model that puts a space before the text; bytes of pieces with U+2581 as space, and of byte pieces."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.space = self.model.piece_to_id("▁")
        # cuts before white space are safe if no piece goes over one, so that white space other than the space itself stands alone
        self.splits = not any(regex.search(rf"[^▁]▁|[{_CUT}].|.[{_CUT}]", p, regex.S) for i, p in enumerate(pieces) if not self.model.is_byte(i))

    def encode(self, text: str) -> list[int]:
        """Of a space and ``text``."""
        return self.model.encode(text, num_threads=1)

    def stretches(self, pieces: list[str]) -> list[list[int] | None]:
        """Of pieces that begin with white space, each as it is within a text; None if that can't be told."""
        out = self.model.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1) if pieces else []
        for k, piece in enumerate(pieces):
            if piece == " ":
                out[k] = [self.space]
            elif piece[0] != " ":
                out[k] = out[k][1:] if out[k] and out[k][0] == self.space else None
        return out


class _State:
    """Which side leads, its unmatched bytes, and the states that the lagging side's tokens lead to."""

    __slots__ = ("a_leads", "residual", "after")

    def __init__(self, a_leads: bool, residual: bytes):
        self.a_leads, self.residual, self.after = a_leads, residual, {}


class Transducer:
    """Aligns two lists of tokens that spell the same bytes."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes]):
        self.a, self.b, self.states, self.known = a, b, {}, 0

    def state(self, a_leads: bool, residual: bytes) -> _State:
        if self.known > REMEMBERED:
            self.states, self.known = {}, 0
        key = a_leads, residual
        if key not in self.states:
            self.states[key] = _State(a_leads, residual)
        return self.states[key]

    def step(self, state: _State, token: int) -> _State:
        """The state after the lagging side's next token; an empty residual closes the group."""
        residual, new = state.residual, (self.b if state.a_leads else self.a)[token]
        if residual.startswith(new):
            onward = self.state(state.a_leads, residual[len(new) :])
        elif new.startswith(residual):
            onward = self.state(not state.a_leads, new[len(residual) :])
        else:
            raise ValueError("the tokens spell different bytes")
        state.after[token] = onward
        self.known += 1
        return onward

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
        """Groups as (first, last + 1) of both lists, and the linked ids."""
        i = j = 0
        groups, links = [], []
        while i < len(a):
            i0, j0 = i, j
            state = self.states.get((True, self.a[a[i]])) or self.state(True, self.a[a[i]])
            i += 1
            while state.residual:
                if state.a_leads:
                    token = b[j]
                    links.append((a[i - 1], token))
                    j += 1
                else:
                    token = a[i]
                    links.append((token, b[j - 1]))
                    i += 1
                state = state.after.get(token) or self.step(state, token)
            groups.append((i0, i, j0, j))
        return groups, links


class Aligner:
    """Aligned texts: (tokens of A, of B, groups, groups as text, linked pairs as packed integers), or None without tokens."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.a, self.b = ByteBpe(a_file), PieceBpe(b_file)
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _aligned(self, text: str, a: list[int], b: list[int] | None):
        """Of ``text``, which holds the space before it already."""
        want, spelt = text.encode(), self.a.bytes
        if b is None or b"".join([spelt[x] for x in a]) != want or b"".join([self.b.bytes[x] for x in b]) != want:
            return None
        groups, links = self.transducer.align(a, b)
        said = ";".join([f"{a[i]}|{b[j]}" if k - i == m - j == 1 else f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}" for i, k, j, m in groups])
        return len(a), len(b), len(groups), said, array("q", [x * WIDTH + y for x, y in links]).tobytes()

    def align(self, text: str | None):
        if not text or "▁" in text:
            return None
        spaced = " " + text
        if not self.b.splits or _ODD.search(text):
            return self._aligned(spaced, self.a.encode(spaced), self.b.encode(text))
        known, parts = self.known, []
        pieces = _STRETCH.findall(spaced)
        for k in range(0, len(pieces), AT_ONCE):
            some = pieces[k : k + AT_ONCE]
            new = []
            for piece in dict.fromkeys(some):
                if piece not in known:
                    if piece in self.older:
                        known[piece] = self.older[piece]
                    else:
                        new.append(piece)
            for piece, b in zip(new, self.b.stretches(new), strict=True):
                known[piece] = self._aligned(piece, self.a.encode(piece), b)
            parts += [known[p] for p in some]
            for piece in new:
                if len(piece) > LONGEST or known[piece] is None:
                    del known[piece]
            if len(known) > REMEMBERED:
                self.older, self.known = known, {}
                known = self.known
        if None in parts:
            return None
        a, b, groups, said, links = zip(*parts, strict=True)
        return sum(a), sum(b), sum(groups), ";".join(said), b"".join(links)


_ALIGNERS: dict[str, Aligner] = {}


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(FILE_BYTES + 1)
    if len(data) > FILE_BYTES:
        raise ValueError(f"{path} has more than {FILE_BYTES} bytes")
    return data


def _decoded(raw: bytes | None) -> str | None:
    """None for what isn't UTF-8."""
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


def align_tokens(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, digest: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups, pairs, times): a row per row of ``docs`` (doc_id long, text string).

    ``groups`` is ``a1,a2|b1;a3|b2,b3``, or its SHA-256 in hex with ``digest``; ``pairs`` are the different linked ids (A's times ``WIDTH``, and B's), ``times`` how often each is linked.
    ``row`` tells rows apart within one evaluation.
    """
    files = docs.sparkSession.sparkContext.broadcast((_file(byte_bpe), _file(piece_bpe)))
    name = f"{byte_bpe}\n{piece_bpe}"

    def run(batches):
        if name not in _ALIGNERS:
            _ALIGNERS.clear()
            _ALIGNERS[name] = Aligner(*files.value)
        aligner, row = _ALIGNERS[name], TaskContext.get().partitionId() << 40
        for batch in batches:
            out, pairs, times = [], [], []
            for raw in batch.column("text"):
                got = aligner.align(_decoded(raw.as_py()))
                if got is None:
                    out.append((row, 0, 0, 0, ""))
                    pairs.append(np.zeros(0, np.int64))
                    times.append(np.zeros(0, np.int32))
                else:
                    *sizes, said, links = got
                    out.append((row, *sizes, hashlib.sha256(said.encode()).hexdigest() if digest else said))
                    ids, n = np.unique(np.frombuffer(links, np.int64), return_counts=True)
                    pairs.append(ids)
                    times.append(n.astype(np.int32))
                row += 1
            if out:
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in pairs])]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([columns[0], batch.column("doc_id"), *columns[1:], *lists], names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), schema)


def _flat(column) -> np.ndarray:
    """The values of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold a pair of ids, and whether no pair of its B id has more."""

    def run(batches):
        ids, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        handed = lambda: pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], names=["pair", "n"])
        for batch in batches:
            ids, inverse = np.unique(np.concatenate([ids, _flat(batch.column("pairs"))]), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([sums, _flat(batch.column("times"))]), len(ids)).astype(np.int64)
            if len(ids) >= SUMMED:
                yield handed()
                ids, sums = ids[:0], sums[:0]
        yield handed()

    counts = aligned.select("pairs", "times").mapInArrow(lean(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("b", F.col("pair") % WIDTH)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _heaviest(counts: DataFrame) -> DataFrame:
    """The commonest pairs, by powers of two of their counts, ``HEAVY`` at most."""
    level = F.floor(F.log2("n")).cast("int")
    held, least = 0, 64
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 64 rows
        if held + row["count"] > HEAVY:
            break
        held, least = held + row["count"], row["level"]
    return counts.where(level >= least)


def link_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of each row: its links that are their B id's commonest, and the corpus-wide counts of its links' pairs summed over the links."""
    heavy = _heaviest(counts).toArrow()
    order = np.argsort(heavy["pair"].to_numpy())
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(heavy[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def run(batches):
        pair, n, best = sent.value
        for batch in batches:
            ids, times = _flat(batch.column("pairs")), _flat(batch.column("times")).astype(np.int64)
            lens = batch.column("pairs").value_lengths().fill_null(0).to_numpy()
            rows = np.repeat(np.arange(len(lens)), lens)
            at = np.minimum(np.searchsorted(pair, ids), max(len(pair) - 1, 0))
            found = pair[at] == ids if len(pair) else np.zeros(len(ids), bool)
            total, top = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
            np.add.at(total, rows[found], times[found] * n[at[found]])
            np.add.at(top, rows[found], times[found] * best[at[found]])
            rest = np.bincount(rows[~found], minlength=len(lens))
            ends = pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[~found])) for x in (ids, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(top), pa.array(total), *lists], names=["row", "n_best", "count_sum", "pairs", "times"])

    seen = written(aligned.select("row", "pairs", "times").mapInArrow(lean(run), "row long, n_best long, count_sum long, pairs array<long>, times array<long>"), "align-seen")
    rest = seen.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(counts, "pair").select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return seen.select("row", "n_best", "count_sum").union(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def packed(aligned: DataFrame) -> DataFrame:
    """``aligned`` as a table whose sorted pairs are stored as differences, in a third of their bytes."""
    path = scratch_path(aligned.sparkSession, "align-tokens")
    aligned.write.options(**{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}).parquet(path)
    return aligned.sparkSession.read.schema(aligned.schema).parquet(path)


def op12_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    aligned = packed(align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True))
    counts = written(pair_counts(aligned), "align-counts")
    links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")
    return aligned.join(link_counts(aligned, counts), "row").select("doc_id", "n_a", "n_b", "n_groups", links, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
