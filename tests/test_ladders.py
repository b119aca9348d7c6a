"""Climbs of all starts at once against one climb after the other."""

import random
from collections import defaultdict

import pytest

from wordloom.operators import ladders


def dealt(items, text):
    """The items in seeded order."""
    state = 2166136261
    for unit in text:
        state = ((state ^ ord(unit)) * 16777619) % 2**32
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        state = (state + 0x6D2B79F5) % 2**32
        a = (state ^ (state >> 15)) * (state | 1) % 2**32
        b = (a ^ (a + (a ^ (a >> 7)) * (a | 61) % 2**32)) % 2**32
        j = int((b ^ (b >> 14)) / 2**32 * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def brute(words, served, rungs, bank):
    spelled = defaultdict(list)
    for w, f in words.items():
        spelled["".join(sorted(w))].append((-f, w))
    best = {k: min(v) for k, v in spelled.items()}
    up = {k: sorted((h, x) for x in set("".join(spelled)) for h in ["".join(sorted(k + x))] if h in best) for k in best}

    def promise(key, left):
        """The least frequency of the best climb of `left` rungs above and with key; 0 for none."""
        return -best[key][0] if left == 1 else min(-best[key][0], max((promise(h, left - 1) for h, _ in up[key]), default=0))

    out = []
    for start in best:
        if rungs > 1 and not max((promise(h, rungs - 1) for h, _ in up[start]), default=0):
            continue
        chain = [start]
        for k in range(1, rungs):
            open_ = [(h, x) for h, x in up[chain[-1]] if promise(h, rungs - k)]
            open_ = [(h, x) for h, x in open_ if best[h][1] not in served] or open_
            chain.append(max(dealt(open_, f"{start}|rung{k}"), key=lambda o: promise(o[0], rungs - k))[0])
        gained = lambda low, high: next(x for x in high if high.count(x) > low.count(x))
        needed = [gained(a, b) for a, b in zip(chain, chain[1:], strict=False)]
        pool = dealt(sorted({x for k in chain[:-1] for _, x in up[k]} - set(needed)), f"{start}|decoy")
        spare = dealt(sorted(set("".join(spelled)) - set(needed) - set(pool)), f"{start}|spare")
        offer = dealt(needed + (pool + spare)[: bank - len(needed)], f"{start}|bank")
        for k, key in enumerate(chain):
            also = {w for x in offer for _, w in spelled.get("".join(sorted(chain[k - 1] + x)), ()) if w != best[key][1]} if k else set()
            out.append((start, k + 1, key, best[key][1], "".join(offer), ",".join(sorted(also))))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_climbs(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("abcd", k=rng.choice([2, 3, 3, 4, 4, 5]))): rng.randint(5, 9) for _ in range(90)}
    served = set(rng.sample(sorted(words), 30))
    table = spark.createDataFrame([(w, "".join(sorted(w)), f) for w, f in words.items()], "surface string, key string, frequency long")
    found = sorted(tuple(r) for r in ladders.climb(table, spark.createDataFrame([(w,) for w in served], "surface string"), 4, 5).collect())
    assert found == brute(words, served, 4, 5) and found
