"""Linking of secret parts by distance, against brute force, and texts with very many matches."""

import random
import re
import time

from opsgraph.llm import secretscan as S

#: kind: pattern, group whose length counts, least, below.
WEAK = ((3, "AKIA[A-Z0-9]+", 0, S.ACCESS_WEAK, S.ACCESS_LEAST), (3, S.IDENT, 2, S.IDENT_LEAST, 1 << 30), (4, S.ASSIGN, 2, S.ASSIGN_WEAK, S.ASSIGN_LEAST), (4, S.BARE, 1, 0, 1 << 30), (5, S.ENDPOINT, 1, 0, 1 << 30))
STRONG = ((0, S.ASSIGN, 2, S.ASSIGN_LEAST, 1 << 30), (1, S.ACCESS, 1, S.ACCESS_LEAST, 1 << 30), (2, S.HEX, 1, 0, 1 << 30))


def found(rules, text):
    return [(m.start(), kind, m.end()) for kind, p, g, least, below in rules for m in re.finditer(p, text) if least <= len(m[g]) < below]


def brute(text):
    base = sorted(found(STRONG, text))
    weak = [w for w in found(WEAK, text) if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    near = lambda w, kinds: any(x[1] in kinds and abs(x[0] - w[0]) <= S.SCOPE for x in base + weak)
    ident, secret = (1, 3), (0, 2, 4)
    keep = {3: lambda w: near(w, secret), 4: lambda w: near(w, ident), 5: lambda w: near(w, ident) and near(w, secret)}
    return sorted(base + [w for w in weak if keep[w[1]](w)])


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[tuple(s) for s in r.secret_spans] for r in S.find(df).orderBy("doc_id").collect()]


def test_links_equal_brute_force(spark):
    r = random.Random(7)
    bits = ["password=abc4567", "token: x" * 3, "AKIA12345678", "AKIA" + "Z9" * 9, "deadbeefdeadbeef00", "client_id=me.too", "username: bob12", "https://host.example/x", "A" * 41, "secret=" + "q" * 20]
    texts = ["".join(r.choice(bits) + " é" * r.choice((1, 3, 40, 90, 127, 128, 129, 200)) for _ in range(r.randint(1, 14))) for _ in range(150)] + [None, ""]
    got = spans(spark, texts)
    assert got == [brute(t or "") for t in texts] and sum(any(s[1] > 2 for s in g) for g in got) > 60


def test_blanks_before_a_text_leave_its_links(spark):
    for gap, linked in ((S.SCOPE, True), (S.SCOPE + 1, False)):
        own = "username: alice ".ljust(gap) + "token=short99"
        got = spans(spark, [" " * n + own for n in range(0, 520, 13)])
        assert [[(a - n, k, b - n) for a, k, b in g] for n, g in zip(range(0, 520, 13), got)] == [[(0, 3, 15), (gap, 4, gap + 13)] if linked else []] * 40


def test_very_many_matches_in_one_text(spark):
    n = 20_000
    text = "id AKIA12345678 token=short99 é " * n
    began = time.time()
    row = S.find(S.redact(spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long"))).first()
    assert time.time() - began < 60  # the square of the matches would take hours
    assert row.text == "id [REDACTED] [REDACTED] é " * n and row.n_chars == len(row.text) and row.secret_spans == []
