"""Rare seeds of the decontamination: which are kept, and what copies they find."""

import random

import numpy as np
import pytest

from netglean.llm import decontaminate
from tests.llm.test_operators import docs, local_score


@pytest.mark.parametrize("seed", range(6))
def test_choice_of_seeds(seed):
    """Against the rule, window by window."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice((0, 1, 2, 3, 5, 9, 13, 14, 40, 90)))) for _ in range(12)]
    items = decontaminate.Items(list(range(12)), texts, 3)
    counts = np.array([rng.choice((0, 1, 3, 50, 400)) for _ in items.key])
    before = list(zip(items.item.tolist(), items.at.tolist(), items.reach.tolist(), items.key[items.of].tolist(), counts[items.of].tolist()))
    most, passage = 6, 13
    items.choose(counts, 1000, 0.01, most, passage)
    want = []
    for item, at, reach, key, n in before:
        size = len(texts[item].split())
        inside = lambda x, a, r: x <= a and min(a + r, size) <= x + passage  # noqa: B023, E731
        windows = [x for x in range(max(size - passage, 0) + 1) if inside(x, at, reach)]
        needy = [x for x in windows if sum(i == item and 0 < m <= 10 and inside(x, a, r) for i, a, r, _, m in before) < most]
        if n and (n <= 10 or needy):
            want.append((item, at, key))
    assert sorted(zip(items.item.tolist(), items.at.tolist(), items.key[items.of].tolist())) == sorted(want)
    assert seed or 0 < len(want) < len(before)


def test_copies_of_every_kind_beside_common_words(spark):
    """A word in three replaced, a word put in after every second, and random edits, of items made half of words that all documents share: recall of each kind is at least 0.9, and nothing else is found."""
    rng = random.Random(21)
    common, words = [f"c{i}" for i in range(12)], [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    items = {i: text(rng.choice((8, 9, 12, 24, 40, 70))) for i in range(12)}
    kinds = {
        "third": lambda item: [y for j, x in enumerate(item) for y in ([f"r{j}"] if j % 3 == 2 else [x])],
        "put in": lambda item: [y for j, x in enumerate(item) for y in ([x, f"r{j}"] if j % 2 else [x])],
        "random": lambda item: [y for x in item for y in ([x] if rng.random() > 0.2 else rng.choice([["other"], [x, "more"], []]))],
        "whole": lambda item: item,
    }
    rows, kind = [], []
    for item in items.values():
        for k, edit in kinds.items():
            rows.append(text(15) + edit(item) + text(15))
            kind.append(k)
    rows += [text(120) for _ in range(30)]
    kind += ["none"] * 30
    want = {(d, i) for d, r in enumerate(rows) for i, item in items.items() if local_score(item, r) >= min(0.5 * 2 * len(item), 26)}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, [(d, " ".join(r)) for d, r in enumerate(rows)]), bench).collect()}
    assert got <= want
    for k in kinds:
        due = {p for p in want if kind[p[0]] == k}
        assert len(due) >= 9 and len(due & got) >= 0.9 * len(due), (k, len(due & got), len(due))
    assert all((d, d // len(kinds)) in got for d, k in enumerate(kind) if k == "whole")


def test_frequencies(spark):
    items = decontaminate.Items([1, 2], ["a b c d", "x y"], 3)
    found, n = decontaminate.frequencies(docs(spark, [(1, "a b c a b c"), (2, "a b q c"), (3, "x y"), (4, None), (5, "x y z")]).repartition(3), items)
    words = {" ".join(k): v for k, v in ((("a", "b", "c"), 2), (("b", "c", "d"), 0), (("a", "c", "d"), 0), (("a", "b", "d"), 0), (("x", "y"), 1))}
    assert n == 5 and sorted(found.tolist()) == sorted(words.values())
    assert decontaminate.frequencies(docs(spark, []), items)[1] == 0
