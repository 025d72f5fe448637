"""Items with words missing at their ends, or twice in them, against brute force."""

import random
from collections import Counter

from lakeforge.llm.contamination import find_contamination


def bag(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def test_truncated_items_are_found(spark):
    rng = random.Random(11)
    common = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    some = lambda n: [rng.choice(common) if rng.random() < 0.7 else rng.choice(common[:12]) for _ in range(n)]
    items = [(i, some(rng.choice([4, 12, 25, 40, 50, 59, 90]))) for i in range(40)]
    items += [(40, items[3][1] * 2), (41, ["a", "b"] * 20), (42, ["a"] * 30)]
    rows = [(900, ["a", "b"] * 18), (901, ["a"] * 60), (902, (["a", "b"] * 20)[1:]), (903, items[5][1][3:])]
    for i, iw in items[:40] * 4:
        room = max(int((len(iw) - 4) * 0.2 / 1.8 + 1e-9), 0)
        left = rng.choice([0, room, rng.randint(0, room)])
        rows.append((len(rows), some(rng.randint(0, 40)) + iw[left : len(iw) - (room - left)] + some(rng.randint(0, 40))))
    want = {}
    for d, w in rows:
        for i, iw in items:
            k, size = min(5, len(iw)), min(len(iw), len(w))
            b = bag(iw, k)
            for start in range(len(w) - size + 1):
                a = bag(w[start : start + size], k)
                both = sum((a & b).values())
                if a and (x := both / (a.total() + b.total() - both)) >= 0.8 and x > want.get((d, i), (0,))[0]:
                    want[(d, i)] = (x, start, size)
    docs = [(d, " ".join(w)) for d, w in rows]
    got = find_contamination(spark.createDataFrame(docs + docs[:9] + [(None, None)], "doc_id long, text string").repartition(3), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert len(got) == len(want) > 150
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in got} == want
