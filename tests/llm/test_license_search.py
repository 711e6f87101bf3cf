"""The search of segments against brute force over all runs of lines."""

import random
from collections import Counter

from spoor.llm import licenses

WORDS = "may use this file under the terms of that license without any warranty free".split()


def by_force(text, templates, threshold):
    lines = [w for w in (licenses._WORD.findall(u) for u in licenses._UNIT.split(text.lower())) if w]
    found = []
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            words = [w for line in lines[i : j + 1] for w in line]
            own = Counter(zip(words, words[1:]))
            for order, (name, template) in enumerate(templates):
                t = licenses._WORD.findall(template.lower())
                other = Counter(zip(t, t[1:]))
                size, n = sum(own.values()), sum(other.values())
                if size and n and 2 * sum((own & other).values()) >= threshold * (size + n):
                    found.append((-2 * sum((own & other).values()) / (size + n), size, i, order, j, name))
    taken, out = set(), []
    for d, _, i, _, j, name in sorted(found):
        if taken.isdisjoint(range(i, j + 1)):
            taken.update(range(i, j + 1))
            out.append((i, j, name, -d))
    return sorted(out)


def test_segments_by_force():
    rng = random.Random(3)
    hits = 0
    for _ in range(400):
        templates = tuple((f"L{k}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 12)))) for k in range(3))
        units = []
        for _ in range(rng.randrange(1, 7)):
            if rng.random() < 0.5:
                words = rng.choice(templates)[1].split()
                cut = rng.randrange(len(words))
                units += [" ".join(words[:cut]), " ".join(words[cut:])]
            else:
                units.append(" ".join(rng.choice(WORDS + ["other", "words"]) for _ in range(rng.randrange(1, 8))))
        text = "\n".join(units)
        want = by_force(text, templates, 0.75)
        got = licenses.matches(text, templates, 0.75)
        assert [(i, j, n, round(d, 9)) for i, j, n, d in got] == [(i, j, n, round(d, 9)) for i, j, n, d in want]
        hits += len(want)
    assert hits > 200


def test_words_after_a_notice_weigh_against_it():
    assert not licenses.matches("All rights reserved seats are sold out.")
    assert [m[2] for m in licenses.matches("All rights reserved.")] == ["LicenseRef-reserved"]


def test_long_text_without_licences():
    assert licenses.matches("some plain words in a line\n" * 20_000) == []
