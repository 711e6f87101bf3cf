"""Toxicity, html, fingerprints, chunks and licences."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.llm import chunks, fingerprint, html, licenses, toxicity


# ---- toxicity --------------------------------------------------------------


def test_grammar_weighs_what_stands_around():
    lexicon = toxicity.Lexicon({"fool": 2.0, "grub*": 1.0})
    score = lambda t: sum(s for s, _ in toxicity.clause_scores(t, lexicon)[0])
    assert score("a fool") == 2.0 and score("nothing here") == 0.0 and score("grubling") == 1.0
    assert score("you fool") > score("a fool") > score("not a fool") and score("he said a fool") < score("he is a fool")
    assert score("the foot was hurt") == 0.0 and score("I will hurt you") > 0 == score("they walk; I hurt")


def test_composition_by_force():
    """The automaton against a reading of the clause that looks back from each word."""
    rng = random.Random(2)
    machines = {m.symbol: m for m in toxicity.MACHINES}
    for _ in range(300):
        symbols = [rng.choice("IHTNROO") for _ in range(rng.randrange(1, 15))]
        state, got = toxicity.GRAMMAR.start, []
        for x in symbols:
            state, factor, active = toxicity.GRAMMAR.step(state, x)
            got.append((round(factor, 9), active))
        want = []
        for i, x in enumerate(symbols):
            on = tuple(m.symbol in symbols[max(0, i - m.words) : i] for m in toxicity.GRAMMAR.contexts)
            factor = machines[x].factor if x in "IH" else 0.0
            for m, yes in zip(toxicity.GRAMMAR.contexts, on):
                factor *= m.factor if yes else 1.0
            want.append((round(factor, 9), on))
        assert got == want


def clause_texts(n, seed, often=()):
    """Texts whose label depends on what stands around: insults and threats at someone are toxic, negated, quoted or aimless ones are not."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("lmnoprst") for _ in range(5))
    bad = ["zorgling", "quibbart", "fropnik"]
    kinds = {
        "insult": (lambda: f"{word()} is {rng.choice(bad)} {word()}", 1), "threat": (lambda: f"I will {rng.choice(['hurt', 'kill', 'beat'])} you", 1), "negated": (lambda: f"{word()} is not a {rng.choice(bad)}", 0),
        "quoted": (lambda: f"{word()} said {word()} is {rng.choice(bad)}", 0), "untargeted": (lambda: f"{word()} would {rng.choice(['hurt', 'kill', 'beat'])} {word()}", 0), "clean": (lambda: rng.choice(["I will meet you", f"you are {word()}", f"{word()} is {word()}"]), 0),
        "weak": (lambda: f"{word()} is grubble {word()}", 0), "aimed": (lambda: f"you are grubble {word()}", 1),
    }
    rows = []
    for i in range(n):
        kind = rng.choice([*kinds, *often])
        clause, toxic = kinds[kind]
        rows.append((i, ". ".join([f"{word()} {word()} {word()}", clause(), f"{word()} {word()}"]), toxic, kind))
    return [r[:3] for r in rows]


def test_each_machine_changes_predictions(spark):
    rows = clause_texts(5000, 4, ["clean"] * 48 + ["untargeted"] * 8 + ["insult"] * 11 + ["aimed"] * 6 + ["threat"] * 3 + ["weak"] * 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    fresh = clause_texts(400, 5)
    texts, y = [r[1] for r in fresh], np.array([r[2] for r in fresh])
    right = lambda grammar: ((toxicity.fit(docs, labels, grammar=grammar).score(texts) >= 0.5) == y).mean()
    whole = right(toxicity.GRAMMAR)
    assert whole > 0.95
    model = toxicity.fit(docs, labels)
    for machine in toxicity.MACHINES:
        less = toxicity.Grammar(*[m for m in toxicity.MACHINES if m is not machine])
        taken_out = toxicity.Model(model.lexicon, model.mean, model.scale, model.coef, less)
        changed = ((taken_out.score(texts) >= 0.5) != (model.score(texts) >= 0.5)).mean()
        assert changed > 0.02, machine.name
        assert right(less) < whole - 0.02, machine.name  # and learning anew without it does not make up for it


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("lmnoprst") for _ in range(5))
    docs, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [word() for _ in range(60)]
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["zorg", "quib"]) + word()[:2]
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").filter("held_out").collect()
    right = [(r["score"] >= 0.5) == bool(r["toxic"]) for r in found]
    assert len(found) > 80 and sum(right) / len(right) > 0.95
    kept = {r["doc_id"] for r in toxicity.accepted(docs, model).collect()}
    assert kept == {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] < 0.5}


def test_held_out_labels_are_not_learned(labelled):
    docs, labels = labelled
    sample, _ = toxicity.labelled_sample(docs, labels, 10_000)
    assert sample.filter(toxicity.held_out(F.col("doc_id"))).count() == 0
    assert toxicity.labelled_sample(docs, labels, 20)[0].count() == 40


def test_toxicity_of_odd_rows(odd_docs, no_docs, labelled):
    model = toxicity.fit(*labelled)
    assert toxicity.score(odd_docs, model).count() == odd_docs.count() and toxicity.score(no_docs, model).count() == 0
    assert toxicity.accepted(odd_docs, model).columns == odd_docs.columns
    none = toxicity.fit(no_docs, labelled[1].limit(0))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd_docs, none).collect())


# ---- html ------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Other things to read</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, please agree to them all.</div>
<article><h1>Head &amp; line</h1><p>First  para<b>graph</b>
with &lt;tags&gt; and &#233; text.<br>Next line.<p>Second paragraph that was not closed<p>Third <a href="x">link</a> here.</article>
<aside>More stories you might like to read next on our pages</aside><div id="comments"><p>Great article, thanks for it, I liked it a lot!</p></div>
<form><input value="q">Search our site</form><footer>&copy; Someone</footer></body></html>"""
TEXT = "Head & line First paragraph with <tags> and é text. Next line. Second paragraph that was not closed Third link here."


def test_article():
    assert html.main_text(PAGE) == TEXT
    assert html.main_text(PAGE[: PAGE.index("<aside>")]) == TEXT  # cut off pages


def test_pages_without_article_elements():
    page = "<body><div class='top'><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div><div><div><p>" + "Long text of the story. " * 9 + "</p><p>" + "And it goes on for a while. " * 8 + "</p></div></div></body>"
    got = html.main_text(page)
    assert got.startswith("Long text") and got.endswith("for a while.") and "Three" not in got


@pytest.mark.parametrize("page", ["", "plain words only", "<p>", "<<<>>>&&&;;", "</div></p>", "<div>" * 5000 + "deep" + "</div>" * 5000, "<!-- unclosed", "<ul><li>a<li>b</ul>"])
def test_odd_pages(page):
    assert isinstance(html.main_text(page), str)


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None), (None, "u", "", "y")], "page_id bigint, url string, html string, text string")
    assert Counter(r["text"] for r in html.extract(pages).collect()) == Counter([TEXT, "", ""])
    assert html.extract(pages.limit(0)).count() == 0


# ---- fingerprints ----------------------------------------------------------


def test_spans_and_extensions():
    rng = random.Random(1)
    text = "".join(rng.choice("abÿ漢🎉") for _ in range(200))
    other = text[:70] + "!" + text[70:]
    h, g = fingerprint.prefix_hashes(text), fingerprint.prefix_hashes(other)
    for _ in range(200):
        a, b, n = rng.randrange(200), rng.randrange(201), rng.randrange(40)
        if a + n <= 200 and b + n <= 201:
            assert fingerprint.equal_spans(h, a, g, b, n) == (text[a : a + n] == other[b : b + n])
    assert fingerprint.common_extension(h, 0, g, 0) == 70 and fingerprint.common_extension(h, 70, g, 71) == 130


def test_pieces_agree():
    rng = random.Random(2)
    long = "".join(rng.choice("abc d") for _ in range(150_000))
    h = fingerprint.prefix_hashes(long + long)
    assert fingerprint.equal_spans(h, 0, h, len(long), len(long)) and not fingerprint.equal_spans(h, 0, h, len(long) + 1, 90_000)


def test_likeness():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdef ") for _ in range(3000))
    f = fingerprint.fingerprint
    assert fingerprint.likeness(f(text), f(text)) == 1.0 and fingerprint.likeness(f(""), f("")) == 1.0 and fingerprint.likeness(f(""), f("a")) == 0.0
    assert 0.6 <= fingerprint.likeness(f(text), f(text[:2000] + "x" * 1000)) <= 2 / 3
    assert fingerprint.likeness(f(text), f(text[:1500] + "inserted" + text[1500:])) > 0.9
    assert fingerprint.likeness(f(text), f(text[::-1])) < 0.1


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_next_documents(odd_docs, texts, partitions):
    low = lambda i: -1 if i is None else i
    order = sorted(texts, key=lambda r: (low(r[0]), r[1]), reverse=True)
    want = Counter()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        want[low(i), len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()] += 1
    rows = fingerprint.fingerprints(odd_docs, partitions).collect()
    assert Counter((low(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == want


def test_fingerprints_of_few(no_docs, odd_docs):
    assert fingerprint.fingerprints(no_docs).count() == 0
    assert fingerprint.fingerprints(odd_docs.filter("doc_id = 4")).first()["near_next"] == 1.0


# ---- chunks ----------------------------------------------------------------


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_repeated_passages(spark):
    rng = random.Random(9)
    passage = prose(rng, 80)
    docs = [(i, prose(rng, 150)) for i in range(40)]
    docs += [(100 + i, f"{prose(rng, 30 + i)} {passage} {prose(rng, 60)}") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in chunks.report(df).collect()}
    assert {i for i, r in rows.items() if r["repeated"]} == set(range(100, 112))
    assert rows[100]["removed_bytes"] == 0 < rows[105]["removed_bytes"] <= len(passage) + 1 and 100 in rows[105]["first_doc_ids"]
    after = {r["doc_id"]: r["text"] for r in chunks.deduplicated(df).collect()}
    assert after[100] == docs[40][1] and len(after[105]) == len(docs[45][1]) - rows[105]["removed_bytes"] and all(after[i] == t for i, t in docs[:40])


def test_odd_chunks(odd_docs, no_docs):
    assert chunks.report(odd_docs).count() == odd_docs.count() and chunks.report(no_docs).count() == 0
    assert chunks.deduplicated(odd_docs).columns == odd_docs.columns and chunks.deduplicated(odd_docs).count() == odd_docs.count()


# ---- licences --------------------------------------------------------------


@pytest.mark.parametrize("name, text", licenses.TEMPLATES)
def test_templates_are_found(name, text):
    around = "Some words before that. More of it.\n"
    for t in (text, text.upper(), around + text + "\nAnd after it.", around + text.replace(" ", "\n", 1)):
        assert name in {m[2] for m in licenses.matches(t)}


def test_other_texts_are_left_alone():
    assert licenses.matches("The licence of the driver was under review.\nPermission was granted to leave.") == [] == licenses.matches("")
    found = licenses.matches("Licensed under the Apache License, Version 2.0.\nwords between them\nAll rights reserved.")
    assert [m[2] for m in found] == ["Apache-2.0", "LicenseRef-reserved"]


def test_dice_by_force():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(2, 9))] for _ in range(2))
        x, y = licenses.bigrams(a), licenses.bigrams(b)
        shared, rest = 0, list(y)
        for g in x:
            if g in rest:
                rest.remove(g)
                shared += 1
        assert licenses.dice(Counter(x), len(x), Counter(y), len(y)) == pytest.approx(2 * shared / (len(x) + len(y)))


def test_license_table(odd_docs, no_docs):
    rows = {r["doc_id"]: r["license"] for r in licenses.scan(odd_docs).collect()}
    assert rows[8] == "CC-BY-NC-4.0" and rows[10] is None and licenses.scan(no_docs).count() == 0
