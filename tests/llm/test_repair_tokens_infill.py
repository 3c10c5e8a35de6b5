"""Conversation repair, token files and fill-in-middle against brute-force versions, with their cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from netloom.llm import infill, repair, token_files
from netloom.llm.queries import vocabulary
from netloom.operators import tables

BYTES = "byte_bpe_50k.json"
CLASHES = ("k", "kind", "th", "n", "code", "fault", "signature", "audit", "part", "before", "ids", "meta", "form", "output", "__c", "__w", "__n")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES})


# --- conversations


def damaged(rows):
    """The damage and the order of rows, a conversation at a time."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        spaced = lambda x: " " if x is None else str(x)
        way = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        out[conv] += [(turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(out[c], key=key) for c in dict.fromkeys(r[0] for r in rows)}


def cheapest(rows, faults):
    """(cost, audit, repaired rows): edits as (cost, letters) from the back, whole strings compared."""
    follow = {"": "ua"[0], "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for s in best:
                to = follow[s]
                c, x, r = best[to]
                best[s] = min(best[s], (c + 5, "I" + x, ((name[to], ""), *r)))
        return best

    never = (10**9, "", ())
    best = inserted({"": (0, "", ()), "a": (0, "", ()), "s": never, "u": never})
    for (_, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        now = {}
        for s in best:
            ways = [(best[s][0] + 2, "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for to in "sua":
                    if (to == "s" and s == "") or follow[s] == to:
                        c, x, r = best[to]
                        if role[:1] == to:
                            ways.append((c + more, "K" + x, ((role, text), *r)))
                        if to != "s":
                            ways.append((c + more + 1, "R" + x, ((name[to], text), *r)))
            now[s] = min(ways)
        best = inserted(now)
    return best[""]


def by_hand(rows):
    out = {}
    for conv, after in damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in after:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, kept = cheapest(after, faults)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        turns = {t for t, _, _ in after if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def talks(n, seed):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rnd.randint(1, 14)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2", "Sys"])
            text = rnd.choice(["Yes.", "No?", "half a", "", " \t", None, "a.b!c? ", "é", "Ends. \n", f"{rnd.random()}.", f"{rnd.random()}"])
            rows.append((conv, rnd.choice([turn, turn, turn, 2 * turn, None]), role, text))
    return rows


def test_conversations(spark):
    rows = talks(150, 3) + [(900, 0, "user", "long. " * 100_000), (900, 1, "assistant", "x" * 300_000 + "."), (901, None, None, None)]
    turns = clashing(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.digest(turns, repair.damage(turns)).collect()}
    assert got == by_hand(rows)
    # An insert never pays at these costs: deleting a neighbour serves the same end.
    assert set("".join(v[6] for v in got.values())) == set("DKR")


def test_one_conversation_of_many_rows_and_a_row_of_many_copies(spark, monkeypatch):
    """Rows of one conversation over many tasks and stretches, with keys that are met as hot ones."""
    monkeypatch.setattr(repair, "STRETCH", 50)
    monkeypatch.setattr(tables, "HOT_ROWS", 3)
    rnd = random.Random(8)
    rows = [(1, t, rnd.choice(["user", "assistant"]), rnd.choice(["Fine.", f"Turn {t}.", f"cut {t}"])) for t in range(1500)] + [(1, 7, "user", "Again.")] * 700
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(2, 60) for t in range(2)]
    turns = spark.createDataFrame(rows, TURNS).repartition(8)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.digest(turns, repair.damage(turns)).collect()}
    assert got == by_hand(rows)


def test_repaired_rows(spark):
    rows = talks(40, 5)
    turns = spark.createDataFrame(rows, TURNS)
    after = repair.damage(turns)
    audited = repair.audits(after)
    kept = defaultdict(list)
    for r in repair.repaired(after, audited).orderBy("k", "place").collect():
        kept[r.k].append((r.place, f"{r.role}:{r.text}"))
    want = by_hand(rows)
    for conv, v in want.items():
        got = kept["" if conv is None else f"={conv}"]
        assert [p for p, _ in got] == list(range(len(got)))
        assert hashlib.sha256("\n".join(x for _, x in got).encode()).hexdigest() == v[7]


def test_each_signature_is_solved_once_and_exactly():
    rnd = random.Random(1)
    for n in [0, 1, 2, 3, 5, 9, 40, 130]:
        for _ in range(60):
            codes = [(rnd.randrange(4), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
            rows = [(0, ["user", "assistant", "system", "tool"][r], "") for r, _ in codes]
            cost, audit, _ = cheapest(rows, [["", "blank", "duplicate", "truncated"][f] for _, f in codes])
            assert repair.solve("".join(repair._code(*c) for c in codes))[:2] == (audit, cost)
    long = "AE" * 300_000
    before = repair.costs.cache_info().misses
    assert repair.solve(long)[:2] == ("K" * 600_000, 0) and repair.costs.cache_info().misses - before < 200


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.digest(none, repair.damage(none)).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    turns = spark.createDataFrame([(5, dropped, "user", "Gone.")], TURNS)
    assert [tuple(r) for r in repair.digest(turns, repair.damage(turns)).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- token files


def texts():
    rnd = random.Random(2)
    words = ["the", "It's", "don't", "  ", "\n\n", "\t", "été", "1234", "x_y", "...", "'re", "A'", "ß", "naïve,", "(a)", "\r\n", " \n ", "_", "²", "日本", "😀", "\x00", "\x1c", " ", "‘q’", "I'LL"]
    out = ["".join(rnd.choice(words) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    return [*out, None, "", " ", "a  ", "  a", "\n", "<|endoftext|> x", out[3], "word " * 80_000, "z" * 50_000]


@pytest.fixture(scope="module")
def tokens(spark, tmp_path_factory):
    rnd = random.Random(4)
    rows = [(rnd.choice([i, i, 7, None]) if i > 20 else i, t, "en") for i, t in enumerate(texts())]
    path = str(tmp_path_factory.mktemp("tokens") / "files")
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    token_files.write(docs, path, vocabulary(BYTES), row_group=1 << 14, page=1 << 10, metadata=("lang", "ids"))
    return path, rows


def test_token_files(spark, tokens):
    from tokenizers import Tokenizer

    path, rows = tokens
    whole = Tokenizer.from_file(vocabulary(BYTES))
    ids = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 0]
    want = sorted((-1 if d is None else d, len(x := ids(t)), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t, _ in rows)
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in token_files.digest(spark, path).collect()]
    assert sorted(g[:3] for g in got) == want
    at = 0
    for doc, n, _, start in sorted(got, key=lambda g: g[3]):
        assert start == at
        at += n
    assert [g[0] for g in sorted(got, key=lambda g: g[3])] == sorted(g[0] for g in got)


def test_token_file_layout(spark, tokens):
    path, rows = tokens
    import glob

    encodings, groups = set(), 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.read_metadata(f)
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                encodings.add((col.path_in_schema.split(".")[0], "DELTA_BINARY_PACKED" in col.encodings, "RLE_DICTIONARY" in col.encodings))
                assert col.has_column_index and col.has_offset_index
    assert ("n_tokens", True, False) in encodings and ("ids", False, True) in encodings and groups > 1
    plan = token_files.read(spark, path, "doc_id", "n_tokens", first=3, last=9)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,3)" in plan and "ids" not in plan.split("ReadSchema")[1]
    few = token_files.read(spark, path, "doc_id", "meta", first=3, last=9).collect()
    assert sorted(r.doc_id for r in few) == sorted(d for d, _, _ in rows if d is not None and 3 <= d <= 9) and few[0].meta.ids == "x"


def test_no_documents_to_encode(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/t", vocabulary(BYTES))
    assert token_files.digest(spark, f"{tmp_path}/t").count() == 0


# --- fill-in-middle


def cut_by_hand(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rnd = random.Random(6)
    parts = ["a line", "é😀", "", "<P", ">", "x<S>", "M>", "\r", "<M>", "日本"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["\n", " ", ""]) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    texts += [None, "", "\n", "\n\n", "no end", "<<P>", "line é\n" * 100_000, "x" * 1_000_000]
    rows = [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    cut = infill.fill_in_middle(docs)
    got = sorted(tuple(r) for r in cut.na.fill(-1).collect())
    want = sorted((-1 if d is None else d, *(-1 if x is None else x for x in cut_by_hand(d, t))) for d, t in rows)
    assert got == want and {g[2] for g in got} == {"plain", "spm", "psm"}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = sorted((r.doc_id if r.doc_id is not None else -1, r.output_sha256, r.restored_sha256) for r in infill.digest(cut).collect())
    assert told == sorted((-1 if d is None else d, sha(cut_by_hand(d, t)[4]), sha(t or "")) for d, t in rows)
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_infill_parameters(spark):
    docs = spark.createDataFrame([(i, "one\ntwo\nthree $1\n") for i in range(400)], "doc_id long, text string")
    how = infill.Infill("$1.", "[s]", "(m)", cut_percent=50, suffix_first_percent=0, seed="other")
    rows = infill.fill_in_middle(docs, how).withColumn("back", infill.restored(F.col("output"), F.col("form"), how)).collect()
    assert {r.form for r in rows} == {"plain", "psm"} and 120 < sum(r.form == "plain" for r in rows) < 280
    assert all(r.back == "one\ntwo\nthree $1\n" for r in rows)
    for bad in [("a", "a", "b"), ("ab", "b", "c"), ("", "b", "c"), ("a\n", "b", "c")]:
        with pytest.raises(ValueError):
            infill.Infill(*bad)
