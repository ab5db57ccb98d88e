"""Many patterns of one form take a key per text, not a comparison with every text that shares a piece."""

import random
import re

from tabulon.operators import joins as J, patterns as P


def test_patterns_with_letters_at_fixed_places(spark, monkeypatch):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("ab1") for _ in range(rng.randrange(1, 8))) for _ in range(400)})
    blank = lambda t: "".join(rng.choice([c, "?"]) for c in t)
    wild = {blank(rng.choice(texts)) for _ in range(150)}
    wild |= {blank(t[: rng.randrange(4)]) + "*" + blank(t[len(t) - rng.randrange(3) :]) for t in rng.choices(texts, k=200)}
    wild |= {"*" + "".join(rng.choice("ab1") for _ in range(n)) + "**" for n in (1, 2, 3, 3, 3, 4)} | {"a*b*1", "a**b", "*a?", "aaaaaaa*aaaaaaa"}
    met = []
    plain = P._by_shape
    monkeypatch.setattr(P, "_by_shape", lambda t, patterns, shapes, p: met.append((patterns.count(), shapes.count())) or plain(t, patterns, shapes, p))
    table = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    asked = spark.createDataFrame([(p,) for p in wild], "pattern string")
    got = {r["pattern"]: r["i"] for r in J.lookup_wildcard(table, "v", asked, ["i"], ["i"]).collect()}

    def first(pattern):
        rx = re.compile(pattern.replace("?", ".").replace("*", ".*"))
        return next((i for i, t in enumerate(texts) if rx.fullmatch(t)), None)

    assert got == {p: first(p) for p in wild}
    assert met[0][0] > 30 and met[0][1] > 2
