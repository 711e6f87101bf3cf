"""Likeness of fingerprints against the texts themselves."""

import os
import random

from spoor.llm import fingerprint


def step_of(n):
    step = 1
    while n > fingerprint.PLACES * step:
        step *= 2
    return step


def by_force(a, b):
    """What the common prefix and the common suffix cover, each down to a place that both fingerprints have."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    step, short = max(step_of(len(a)), step_of(len(b))), min(len(a), len(b))
    ahead = len(os.path.commonprefix([a, b])) // step * step
    behind = len(os.path.commonprefix([a[::-1], b[::-1]])) // step * step
    return min(ahead + behind, short) / max(len(a), len(b))


def test_likeness_by_force():
    rng = random.Random(7)
    draw = lambda n: "".join(rng.choice("ab é漢") for _ in range(n))
    some = 0
    for _ in range(600):
        a = draw(rng.choice([0, 1, 5, 31, 32, 33, 100, 700]))
        kind = rng.randrange(4)
        at, n = rng.randrange(len(a) + 1), rng.randrange(20)
        b = [a, a[:at] + draw(n) + a[at:], a[:at] + a[at + n :], draw(rng.randrange(200))][kind]
        one, two = fingerprint.fingerprint(a), fingerprint.fingerprint(b)
        got = fingerprint.likeness(one, two)
        assert got == by_force(a, b) == fingerprint.likeness(two, one) and 0 <= got <= 1
        assert (one == two) == (a == b)
        some += 0 < got < 1
    assert some > 100
