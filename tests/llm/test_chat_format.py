import hashlib
import random

import pytest

from veritally.llm import chat_format as C
from veritally.llm.tokens import VOCABULARY, Counter

SCHEMA = "conv_id long, turn long, role string, text string, key string, pack int"
COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@pytest.fixture(scope="module")
def bpe():
    with open(VOCABULARY, "rb") as f:
        return Counter(f.read()).bpe


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        tie = hashlib.sha256(f"{role}\n{text}".encode()).hexdigest()
        convs.setdefault(conv, []).append((turn is None, turn or 0, tie, role, text))
    convs[-7] = [(False, i, "", r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    out = []
    for conv, turns in convs.items():
        turns = [t[3:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        size = sum(len("".join(C.MARKS)) + len(C.escape(r)) + len(C.escape(t)) for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=repr)


def conversations(seed=1):
    """Trees: copies, prefixes of others, common first turns, long ones, control strings, unusual rows."""
    rng = random.Random(seed)
    pieces = ["hello ", "</s>", "[INST]", "[\\INST]", "<\\\\|turn|>", "<|end|>", "\\", "<", "é中🙂", "\n", "<<SYS>>", "<s><s>", "[/INST] ok"]
    rows, i = [], 0
    for _ in range(12):
        stem = [(rng.choice(["system", "user"]), "".join(rng.choices(pieces, k=3)))] + [("assistant" if k % 2 else "user", "".join(rng.choices(pieces, k=4))) for k in range(3)]
        for _ in range(rng.randint(1, 8)):
            turns = stem[: rng.randint(1, 4)] + [("assistant", "".join(rng.choices(pieces, k=rng.randint(0, 6)))) for _ in range(rng.randint(0, 3))]
            rows += [(i, k, r, t) for k, (r, t) in enumerate(turns)]
            i += 1
    rows += [(900, k, "assistant" if k % 2 else "user", f"turn {k % 7}") for k in range(2500)]
    rows += [(901, 0, None, None), (902, None, "assistant", "last"), (902, 5, "user", "first"), (902, 5, "user", "tie"), (902, 5, "user", "tie"), (None, 0, "a\nb", "no id"), (None, 1, "assistant", ""), (903, 0, "<|text|>user", "x" * 50_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("run, pack, page, common", [(1024, 32_768, 16_384, 10_000), (3, 60, 25, 2)])
def test_query(spark, tmp_path, monkeypatch, run, pack, page, common):
    for name, value in (("RUN", run), ("PAGE", page), ("COMMON", common)):
        monkeypatch.setattr(C, name, value)
    rows = conversations()
    path = str(tmp_path / "conversations.parquet")
    frame(spark, rows).repartition(3).write.parquet(path)
    monkeypatch.setattr(C.format_chats, "__defaults__", (VOCABULARY, pack))
    got = C.op13_chat_formatting(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(map(tuple, C.op13_chat_formatting(spark, str(tmp_path)).select(*COLUMNS).collect())) == brute([])
    pages, members = C.format_chats(frame(spark, []))
    assert pages.count() == members.count() == 0


def test_packs(spark, bpe):
    """Shared turns stand once per pack, depth-first; ``attends`` and positions are those of each conversation on its own; the mask is the assistants' texts."""
    rows = [r for r in conversations(4) if r[0] is not None and r[0] < 900]
    pages, members = C.format_chats(frame(spark, rows), pack_tokens=400)
    packs, of = {}, {r.key: [] for r in members.collect()}
    for r in members.collect():
        of[r.key].append(r.conv_id)
    for p in pages.orderBy("pack", "page").collect():
        assert len(p.tokens) == len(p.positions) == len(p.loss)
        pack = packs.setdefault(p.pack, {"tokens": [], "positions": [], "loss": [], "nodes": []})
        for c in pack:
            pack[c] += p[c]
    text = {}
    for conv, turn, role, t in rows:
        text.setdefault(conv, []).append((role or "", t or ""))
    met = []
    for pack in packs.values():
        nodes, seen = pack["nodes"], set()
        assert [n.node for n in nodes] == list(range(len(nodes))) and (len(pack["tokens"]) <= 400 or sum(n.key is not None for n in nodes) == 1)
        for n in nodes:
            up, at = [], n
            while at.parent >= 0:
                at = nodes[at.parent]
                up.append(at)
            assert n.depth == len(up) and (not up or up[0].node == n.node - 1 or nodes[n.node - 1].depth >= n.depth)
            sees = [i for a in n.attends for i in range(a.start, a.end)]
            assert sees == sorted(i for a in up for i in range(a.start, a.end)) and all(a.end < b.start for a, b in zip(n.attends, n.attends[1:], strict=False))
            line = [*sees, *range(n.start, n.end)]
            assert [pack["positions"][i] for i in line] == list(range(len(line)))
            path = tuple(pack["tokens"][i] for i in line)
            assert path not in seen
            seen.add(path)
            if n.key is not None:
                mark = [bpe.n_vocab + k for k in range(3)]
                for conv in of[n.key]:
                    want, loss = [], []
                    for role, t in text[conv]:
                        head, body = bpe.encode_ordinary(C.escape(role)), bpe.encode_ordinary(C.escape(t))
                        want += [mark[0], *head, mark[1], *body, mark[2]]
                        loss += [False] * (len(head) + 2) + [role == "assistant"] * len(body) + [False]
                    assert list(path) == want and [pack["loss"][i] for i in line] == loss
                    met.append(conv)
    assert sorted(met) == sorted(text)


def test_escapes():
    rng = random.Random(2)
    pieces = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<s>", "</s>", "[INST]", "<<SYS>>", "<</SYS>>", "|turn|>", "|im_end|>", "x"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        out = C.escape(text)
        assert C.unescape(out) == text and not any(c in out for c in C.CONTROL)


def test_invalid_utf8(spark):
    from pyspark.sql import functions as F

    bad = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.expr("cast(unhex('61FF62') as string)").alias("text"))
    pages, members = C.format_chats(bad)
    (got,) = C.by_conversation(members, C.read_back(pages)).collect()
    assert got.loss_chars == 3 and got.loss_sha256 == hashlib.sha256("a�b".encode()).hexdigest()
