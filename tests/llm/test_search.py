import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from changeflow.llm import search

DOCS = "doc_id long, text string, item long, item_id string, m long, rank int, class int, score double"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


def brute(docs, items, top=20):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(x for _, c in counted for x in c)
    out = []
    for item_id, text in items:
        scores = []
        for d, c in counted:
            m = 75 + 25 * c.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * c[x] // (1000 * c[x] + 12 * m)) for x in terms(text))
            scores += [(-score, d is None, d)] * (score > 0)
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores)[:top])]
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    docs = [(i, " ".join(f"w{(i * 13 + k * k) % 37}" for k in range(5 + i % 7))) for i in range(60)]
    docs += [(100 + i, "Same words, same WORDS: alpha_beta") for i in range(45)]  # a class larger than the result
    docs += [(99, "beta alpha same; same words words"), (None, "alpha beta gamma"), (None, None), (7, "w1 w2"), (7, "w1 w2"), (500, None), (501, ""), (502, "_ - !"),
             (503, "Éa éa x" + "y" * 90), (504, "long " * 30000 + "alpha")]
    items = [("a", "alpha words"), ("b", "w1 w2 w2 W3"), ("b", "same"), ("c", None), ("d", "nowhere"), ("e", "éa"), ("f", "Éa x" + "Y" * 90), (None, "gamma"), ("g", "alpha " * 5)]
    return docs, items


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_search_matches_brute_force(spark, rows, block):
    docs, items = rows
    frame = spark.createDataFrame([(*x, None, None, 1, 2, 3, 0.5) for x in docs], DOCS)
    got = search.ranked(frame, spark.createDataFrame(items, "item_id string, text string"), block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute(docs, items)


def test_search_of_nothing(spark, rows):
    docs, items = (spark.createDataFrame(x, f"{name} string, text string") for x, name in zip(rows, ("doc_id", "item_id"), strict=True))
    assert search.ranked(docs.where("false"), items).count() == search.ranked(docs, items.where("false")).count() == 0
    assert search.ranked(docs.where("text IS NULL"), items).count() == 0


def test_rows_whose_terms_many_items_use_are_scored_few_at_a_time():
    starts, items = np.array([0, 400, 401]), 400  # the first term is in all items, the second in one
    common, rare = np.array([[0, 1]], "<u4").tobytes(), np.array([[1, 1]], "<u4").tobytes()
    bags = pa.array([common] * 3000 + [rare] * 3000 + [b""])
    cuts = list(search._cuts(bags, starts, items))
    assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(bags)
    for a, b in cuts:
        uses = sum(400 if x.as_py() == common else 1 if x.as_py() else 0 for x in bags[a:b])
        assert uses + (b - a) * items <= search.CELLS + 800
    assert not list(search._cuts(pa.array([], pa.binary()), starts, items))
