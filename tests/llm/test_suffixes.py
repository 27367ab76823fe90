import glob
import hashlib
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from changeflow.llm import suffixes
from changeflow.llm.shared import stored
from changeflow.session import shared_folder

DOCS = "doc_id long, text string, block long, number int, start long, size long, bytes binary, same string"


def brute(rows):
    """Rows in the order of ids, those without one last, equal ids by the digest of the text."""
    def place(row):
        return row[0] is None, row[0], hashlib.sha256((row[1] or "").encode()).digest()[:16]

    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda row: (row[0] is None, row[0] or 0, place(row)[2])):
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                covered[p : p + 100] = True
            seen.add(window)
        rest = bytes(x for x, gone in zip(data, covered.tolist(), strict=True) if not gone)
        out.append((doc_id, len(data), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return Counter(out)


def cases():
    r = random.Random(3)
    words = ["".join(r.choices("abcdeé", k=r.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=r.choice([3, 30, 120]))) for _ in range(120)]
    passage = " ".join(r.choices(words, k=60))
    rows = [(i, text) for i, text in enumerate(texts)]
    for i in range(150):  # pieces of texts at every shift, in other texts
        text = r.choice(texts)
        a, n = r.randrange(len(text)), r.choice([98, 99, 100, 101, 130, 400])
        rows.append((200 + i, "x" * r.randrange(60) + text[a : a + n] + r.choice(["", "!", passage[: r.randrange(len(passage))]])))
    rows += [(1000 + i, texts[2]) for i in range(60)] + [(2000 + i, texts[2][: -i - 1] + "?" * i) for i in range(60)]
    rows += [(3000, "ab" * 400), (3001, "a" * 100), (3002, "a" * 99), (3003, "a" * 101), (3004, None), (3005, ""), (None, texts[5]), (None, texts[5]), (None, None), (7, texts[9]), (7, texts[7])]
    rows += [(4000, passage), (-1, passage[3:]), (5000, "é" * 50 + "b" * 49), (5001, "é" * 50 + "b" * 50)]
    return rows


def test_repeats_match_brute_force(spark):
    rows = cases()
    frame = spark.createDataFrame([(*row, 1, 2, 3, 4, None, "x") for row in rows], DOCS)
    want = brute(rows)
    assert want == Counter(map(tuple, suffixes.removed_repeats(frame).collect()))
    shuffled = frame.orderBy("text").repartition(9)
    assert want == Counter(map(tuple, suffixes.removed_repeats(shuffled).collect()))


def test_windows_sent_in_several_times(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "ONCE", 0)
    monkeypatch.setattr(suffixes, "TIMES", 3)
    rows = cases()
    known = set(glob.glob(f"{shared_folder(spark)}/repeats-*"))
    frame = spark.createDataFrame([(*row, 1, 2, 3, 4, None, "x") for row in rows], DOCS)
    assert brute(rows) == Counter(map(tuple, suffixes.removed_repeats(frame).collect()))
    assert len(set(glob.glob(f"{shared_folder(spark)}/repeats-*")) - known) == 3


def test_stored_rows_leave_no_shuffle_files(spark):
    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name.split("_")[1] for name in blocks.mkString(" ").split() if name.startswith("shuffle_")}

    before = shuffles()
    rows = stored(spark.range(1000).selectExpr("id % 7 AS key").groupBy("key").count(), "counted")
    end = time.time() + 3
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert rows.count() == 7


def test_long_texts_and_pieces(spark):
    """Texts above one piece, with repeats across its edge; ids that are text."""
    r = random.Random(4)
    base = "".join(r.choices("abcdefgh ", k=1_100_000))
    rows = [("a", base), ("b", base[suffixes.PIECE - 70 : suffixes.PIECE + 60]), ("c", "z" * (suffixes.PIECE - 50) + base[500:700] + "z"), ("d", base[1_000_000:] + base[:50])]
    got = {row["doc_id"]: row for row in suffixes.cleaned(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert [(got[x]["n_removed"], got[x]["n_spans"]) for x in "abd"] == [(0, 0), (130, 1), (100_000, 1)]
    # Of a run of one letter only the first window starts nowhere earlier, and the second covers all but its first byte.
    assert bytes(got["c"]["kept"]) == b"zz" and (got["c"]["n_removed"], got["c"]["n_spans"]) == (len(rows[2][1]) - 2, 1)
    assert bytes(got["d"]["kept"]).decode() == base[:50]


def test_nothing_and_short(spark):
    assert suffixes.removed_repeats(spark.createDataFrame([], DOCS)).count() == 0
    got = suffixes.removed_repeats(spark.createDataFrame([(1, "short"), (1, "short"), (2, None)], "doc_id long, text string")).collect()
    assert Counter((row["n_bytes"], row["n_removed"], row["n_spans"]) for row in got) == {(5, 0, 0): 2, (0, 0, 0): 1}


def test_cover_and_runs():
    c = suffixes.COVER.tolist()
    assert {(a - b) % suffixes.MODULUS for a in c for b in c} == set(range(suffixes.MODULUS))
    sizes = np.array([0, 99, 100, 101, 157, 400])
    at, document = suffixes._cover(sizes)
    starts = np.cumsum(sizes) - sizes
    assert list(zip(at.tolist(), document.tolist(), strict=True)) == [(starts[i] + p, i) for i, n in enumerate(sizes) if n >= 100 for p in range(n - suffixes.SAMPLE + 1) if p % 57 in c]
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (suffixes._values(suffixes._run(values)) == values).all()


def test_windows_that_share_one_fingerprint():
    """Equal first fingerprints with different second ones stay apart; of equal windows the lowest rank keeps."""
    run, owners = suffixes._run(np.array([5, 9, 12], np.uint64)), suffixes._planes(np.array([0, 1, 0], np.uint32))
    ranks = [suffixes._run(np.array(x, np.uint64)) for x in ([10, 30], [20, 21])]
    more = [np.array(x, "<u4").tobytes() for x in ([1, 7, 4], [2, 7, 4])]
    table = pa.table({"bucket": [0, 0], "block": [2, 1], "run": [run, run], "more": more, "owners": [owners, owners], "ranks": ranks})
    out = suffixes._later(table).to_pylist()
    assert [(x["block"], np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=3).tolist()) for x in out] == [(2, [0, 1, 0]), (1, [0, 0, 1])]
