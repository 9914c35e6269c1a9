"""Fill-in-the-middle and line deduplication against plain versions of what they compute."""
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import infill, lines, queries

from . import fixtures as fx

BLANK = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- op11 -----------------------------------------------------------------------------------------------------------

def plain_infill(doc_id, text, seed=7, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in infill.MARKERS):
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def awkward(n=60):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        text = "".join(rng.choice(["a", "é", "😀", "\n", "\n\n", "<", "P", ">", "<S", " x y z ", "\r\n", "word " * 9]) for _ in range(rng.randint(0, 150)))
        rows.append((i * 13 - 50, text))
    rows += [(900 + i, "\n" * i) for i in range(4)] + [(910, "no end"), (911, "a<P>b\nc"), (912, "<M>"), (913, "<<S>"), (914, "x\n<" + "S" * 600 + ">\n"), (None, "first\nsecond\nthird"), (None, None)]
    rows += [(950, "long\n" * 3000 + "é" * 5000)] * 3 + [(951, "long\n" * 3000 + "é" * 5000), (952, "y" * 9000), (953, "z\n" * 4000 + "<M>")]
    return rows


@pytest.mark.parametrize("lane, piece, whole", [(512, 1 << 20, 1 << 20), (3, 64, 100), (16, 1000, 2000), (7, 5, 0)])
def test_infill_whatever_the_pieces(spark, lane, piece, whole):
    """The same rows whether texts are scanned whole or in pieces of any size, characters parted or not."""
    rows = awkward()
    if piece < 10:
        rows = [r for r in rows if len(r[1] or "") < 1000]
    docs = spark.createDataFrame(rows, "Doc_ID long, text string").withColumns({"n": F.lit(1), "form": F.lit("x"), "copy": F.lit(b"y")})
    made = infill.transform(docs, lane=lane, piece=piece, whole=whole)
    got = made.withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain_infill(d, t) for d, t in rows), key=key)
    assert {(r.doc_id, sha(r.back)) for r in got} == {(d, sha(t or "")) for d, t in rows}


def test_infill_of_an_empty_table_and_rates(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.transform(docs, whole=0).collect() == []
    docs = spark.createDataFrame([(i, "a\nb\n") for i in range(300)], "doc_id long, text string")
    forms = lambda **k: {r.form for r in infill.transform(docs, **k).collect()}
    assert forms(plain_percent=100) == {"plain"} and forms(spm_percent=100) == {"spm"} and forms(spm_percent=0) == {"psm"}
    assert forms(plain_percent=30) == {"plain", "psm", "spm"}


def test_infill_of_other_units_and_markers(spark):
    """Words as units: an automaton that counts the first byte after a blank."""
    table = np.full((2, 256), 2, np.uint16)
    table[:, ord(" ")] = 0
    table[0, [c for c in range(256) if c != ord(" ")]] += 1
    rows = [(i, " ".join("wörd" for _ in range(i % 9)) + "  x") for i in range(40)]
    made = infill.transform(spark.createDataFrame(rows, "doc_id long, text string"), auto=infill.Automaton(table), markers=("[1", "[2", "[3"), seed=8, lane=4)
    back = {r.doc_id: r for r in made.withColumn("back", infill.restored(F.col("form"), F.col("output"), ("[1", "[2", "[3"))).collect()}
    for i, t in rows:
        assert back[i].back == t and back[i].n == len(t.split())
        cut = t[:back[i].prefix_chars]
        assert cut == t or t[len(cut)] != " " and (not cut or cut[-1] == " ")
    for bad in (("a", "ab", "c"), ("<x", "<y", "z<"), ("", "b", "c"), ("a", "a", "c")):
        with pytest.raises(ValueError):
            infill.check_markers(bad)


def test_automata_by_their_definition():
    rng = random.Random(2)
    strings = ("abab", "ba", "bb")
    auto = infill.Automaton.of_strings(strings)
    for _ in range(50):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        raw, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
        start, length, nth = infill.lanes_of(offsets, rng.randint(1, 9))
        ends, counts = infill.run_lanes(auto, raw, start, length)
        for s, k, e, c in zip(start, length, ends, counts):  # every lane from every state, byte by byte
            for q in range(auto.states):
                state, seen = q, 0
                for b in raw[s:s + k]:
                    seen += int(auto.table[state, b]) & 1
                    state = int(auto.table[state, b]) >> 1
                assert (e[q], c[q]) == (state, seen)
        ends, counts = infill.compose(ends, counts, nth)
        assert counts[-1, 0] == sum(any(text[:i].endswith(s) for s in strings) for i in range(1, len(text) + 1))


def test_op11_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.QUERIES["op11_fill_in_middle"](spark, sf_dir).collect()}
    assert got == {(*p[:5], sha(p[5]), sha(r.text or "")) for r in rows for p in [plain_infill(r.doc_id, r.text)]}


# --- op12 -----------------------------------------------------------------------------------------------------------

def line_key(line: str) -> str:
    return fx.lower(line.strip(BLANK))


def plain_lines(rows, chars=20, documents=3):
    """What each row keeps, by its index."""
    order = lambda d: -2**63 if d is None else d
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= chars:
                held[line_key(line)].add(order(d))
    out = []
    for d, t in rows:
        split = (t or "").split("\n")
        gone = [len(k := line_key(x)) >= chars and len(held[k]) >= documents and max(held[k]) != order(d) for x in split]
        out.append((d, len(split), sum(gone), "\n".join(x for x, g in zip(split, gone) if not g), gone))
    return out


def documents_of_lines(n=150, seed=4):
    rng = random.Random(seed)
    common = [f"{w} and so this line is found again {w}" for w in ("one", "Two", "ééé", "x" * 300)] + ["short", "just twenty letters!", "nineteen letters ok", "ééééééééééééééééééé", "éééééééééééééééééééé", ""]
    rows = []
    for i in range(n):
        text = [rng.choice(common) if rng.random() < .6 else f"line of its own {rng.random()}" for _ in range(rng.randint(0, 12))]
        text = [rng.choice(["", " ", "\t", "\x85", " "]) + rng.choice([x, x.upper()]) + rng.choice(["", "\r", "  "]) for x in text] + ["Everyone has this very line."] * rng.choice([0, 1, 1, 3])
        rows.append((rng.randint(0, n) if i % 10 else i, "\n".join(text)))
    twice = "found in two documents only, first\nfound in two documents only, second"
    rows += [(5000, twice), (5001, twice), (5001, twice), (None, twice.upper()), (None, "Everyone has this very line."), (6000, None), (6001, ""), (6002, "\n\n")]
    rows += [(7000, rows[0][1])] * 40 + [(7000, "another text\nEveryone has this very line.")] + [(7001 + i, rows[1][1]) for i in range(5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chars, documents", [(20, 3), (1, 2), (20, 5)])
def test_lines_equal_brute_force(spark, chars, documents):
    rows = documents_of_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"keep": F.lit(1), "N_lines": F.lit(2), "line": F.lit("x"), "_doc": F.lit(3)}).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        got = lines.cleaned(docs, chars, documents)
        assert got.columns == ["doc_id", "text", "line", "_doc", "n_lines", "n_dropped", "keep"]
        got = got.collect()
        bitmaps = lines.with_bitmaps(docs, chars, documents, texts=False).select("doc_id", "n_lines", "n_dropped", "keep").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain_lines(rows, chars, documents)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    marks = lambda d, n, gone: (d, n, tuple(gone))
    assert sorted((marks(r.doc_id, r.n_lines, ~lines.kept_lines(r.keep, r.n_lines)) for r in bitmaps), key=key) == sorted((marks(w[0], w[1], w[4]) for w in want), key=key)


def test_lines_of_nothing(spark):
    assert lines.cleaned(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = lines.cleaned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert [(r.text, r.n_lines, r.n_dropped, r.keep) for r in got] == [("", 1, 0, None)] * 2


def test_first_occurrences_over_any_edges():
    """The pass over sorted rows, cut into any partitions and batches: decided rows and edges give the same."""
    import pyarrow as pa
    rng = random.Random(9)
    for _ in range(120):
        rows = sorted({(rng.choice("aaaabc"), -rng.randint(1, 6), rng.randint(0, 1), rng.randint(0, 2)) for _ in range(rng.randint(1, 40))})
        docs = defaultdict(set)
        for k, d, *_ in rows:
            docs[k].add(-d)
        want = {(-d, c, p, k) for k, d, c, p in rows if len(docs[k]) >= 3 and max(docs[k]) != -d}
        column = lambda part: pa.RecordBatch.from_arrays([
            pa.array([k.encode() * 16 for k, *_ in part], pa.binary()), pa.array([-r[1] for r in part], pa.int64()),
            pa.array([bytes([r[2]]) * 16 for r in part], pa.binary()), pa.array([r[3] for r in part], pa.int32())], ["line", "doc", "copy", "place"])
        cut = lambda part: [x for x in np.array_split(np.arange(len(part)), rng.randint(1, 5))]
        gone, edges = set(), []
        for part in cut(rows):
            part = [rows[i] for i in part]
            for b in lines._streamed(3)(iter([column([part[i] for i in x]) for x in cut(part)])):
                for r in b.to_pylist():
                    row = (r["doc"], r["copy"][0], r["place"], chr(r["line"][0]))
                    edges.append((row, r["docs"])) if r["docs"] is not None else gone.add(row)
        for row, _ in edges:
            of_key = [(r, n) for r, n in edges if r[3] == row[3]]
            if (max(n for _, n in of_key) >= 3 or len({r[0] for r, _ in of_key}) >= 3) and row[0] < max(r[0] for r, _ in of_key):
                gone.add(row)
        assert gone == want


def test_op12_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.QUERIES["op12_line_dedup"](spark, sf_dir).collect()} == {(d, n, g, sha(t)) for d, n, g, t, _ in plain_lines(rows)}
