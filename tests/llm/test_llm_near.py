"""Proximity matches against a plain version, whatever the batches are."""

import random
import re
from collections import Counter

import pytest

from readloom.llm import decontaminate


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def plain_near(docs, items):
    split = [words(t) for t in docs]
    often = Counter(w for d in split for w in set(d))
    out = [set() for _ in docs]
    for name, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1):
            own = list(dict.fromkeys(w[i : i + size]))
            need = min(4, len(own))
            rare = sorted((x for x in own if often[x]), key=lambda x: often[x])[:6]
            for found, d in zip(out, split, strict=True):
                for p, x in enumerate(d):
                    if len(rare) >= need and x in rare[: len(rare) - need + 1] and len(set(rare) & set(d[max(0, p - size - 4) : p + size + 5])) >= need:
                        found.add(str(name))
    return out


@pytest.mark.parametrize("batch", [512, 7, 1])
def test_near_items_do_not_depend_on_batches(spark, monkeypatch, batch):
    monkeypatch.setattr(decontaminate.build_index, "__defaults__", ("doc_id", "text", batch, 1 << 20))
    r = random.Random(11)
    draw = lambda n: [f"w{int(120 * r.random() ** 2)}" for _ in range(n)]
    items = [(i, " ".join(draw(n))) for i, n in enumerate((3, 9, 10, 14, 25))] + [(9, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    texts = [" ".join(draw(r.choice([0, 5, 40, 120]))) for _ in range(40)]
    for k in range(10):  # one word of the passage replaced; nothing else holds the word
        one = items[-1][1].split()
        one[k] = "other"
        texts.append(" ".join([*draw(20), *one, *draw(20)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {x["doc_id"]: set(x["near_items"]) for x in found}
    assert got == dict(enumerate(plain_near(texts, items)))
    assert all("9" in got[i] for i in range(40, 50))
