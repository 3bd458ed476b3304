"""Decontamination against a plain version: templates as lists of words, windows as tuples, every item against every document."""

import collections
import random

import pytest

from quillspark.llm import decontam

TRIM = "\"'()[]{}<>.,;:!?«»„“”"


def template(text):
    """(template word, raw word without punctuation, whether it is a slot) of every word; a line's end begins a sentence."""
    out, start, number = [], True, False
    for line in (text or "").split("\n"):
        for w in line.split():
            bare, low = w.strip(TRIM), w.strip(TRIM).lower()
            if decontam.NUMBER.fullmatch(w):
                out.append(("<num>", low or w, True, bare))
            elif low in decontam.UNITS:
                out.append(("<unit>" if number else low, low, number, bare))
            elif bare[:1].isupper() and not bare.isupper() and not start:
                out.append(("<name>", low, True, bare))
            else:
                out.append((low or w, low or w, False, bare))
            number = out[-1][0] == "<num>"
            start = w.rstrip("\"')]»”")[-1:] in tuple(".!?:") and w[-1:] != ""
        start, number = True, False
    return out


def windows(t, size):
    """At each place: what a window is compared by, and whether it has words enough to tell it."""
    out = []
    for k in range(len(t) - size + 1):
        part = t[k : k + size]
        told = 2 * sum(p[2] for p in part) <= size
        out.append((("template", *(p[0] for p in part)) if told else ("raw", *(p[1] for p in part)), told))
    return out


def brute(docs, items, window=8):
    found = {}
    for item, text in items:
        t = template(text)
        if len(t) < 5:
            continue
        size = len(t) if len(t) <= window else 4 if len(t) < 40 else window
        own = windows(t, size)
        for doc, body in docs:
            d = template(body)
            lines = collections.defaultdict(set)
            for pos, (h, _) in enumerate(windows(d, size)):
                for at, (g, _) in enumerate(own):
                    if g == h:
                        lines[pos - at].add(at)
            kept = set()
            for line, ats in lines.items():
                pairs = lambda at: {(t[k][3], d[k + line][3]) for k in range(at, at + size) if t[k][2]}  # noqa: B023, E731
                every = set().union(*map(pairs, ats))
                against = lambda x, y: (x[0] == y[0]) != (x[1] == y[1])
                bad = {x for x in every if x[0] != x[1] and any(against(x, y) for y in every)}
                if all(any(y[0] == y[1] and against(x, y) for y in every) for x in bad):
                    kept |= {at for at in ats if not pairs(at) & bad}
            told = {at for at in kept if own[at][1]}
            words = lambda ats: len({k for at in ats for k in range(at, at + size)})  # noqa: B023, E731
            n_told, all_told = sum(x for _, x in own), words({k for k, (_, x) in enumerate(own) if x})
            if window < len(t) < 40:
                cover = max(words(kept) / len(t), words(told) / all_told if all_told else 0)
                hit = cover >= 0.55 and words(kept) >= 5
            else:
                cover = max(len(kept) / len(own), len(told) / n_told if n_told else 0)
                hit = cover >= 0.5
            if hit:
                found[doc, item] = round(cover, 9)
    return found


def sample(seed):
    rnd = random.Random(seed)
    names, nouns = ["Tom", "Mary", "Rome", "Oslo", "Anna", "NASA"], ["apple", "farm", "road", "boat", "kg", "hours", "años", "km/h", "market", "house", "runs", "sold", "and", "the"]
    word = lambda: rnd.choice([str(rnd.randint(1, 30)), rnd.choice(names), *[rnd.choice(nouns)] * 4]) + rnd.choice(["", "", "", ",", "."])
    items = [(k, " ".join(word() for _ in range(rnd.choice([3, 5, 7, 9, 14, 30, 45, 60])))) for k in range(24)]
    items += [(90, "7 8 9 10 11 12 13 14 15 16 17 18"), (91, "see Tom Mary Anna Peter Paul John Ruth Noah Ada Ben"), (92, None), (93, "")]
    docs = []
    for k in range(60):
        body = rnd.choice(items)[1] or ""
        said = body.split()
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            if said:
                said[rnd.randrange(len(said))] = word()
        if rnd.random() < 0.4:
            other = dict(zip(names, rnd.sample(names, len(names)), strict=True))
            said = [other.get(w, w) for w in said]
        noise = [word() for _ in range(rnd.randint(0, 30))]
        at = rnd.randint(0, len(noise))
        docs.append((k, " ".join(noise[:at]) + rnd.choice([" ", "\n"]) + " ".join(said) + rnd.choice([" ", "\n"]) + " ".join(noise[at:])))
    return [*docs, (100, None), (101, ""), (None, items[90 - 90][1]), (102, items[24][1]), (103, items[25][1])], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_plain_version(spark, seed):
    docs, items = sample(seed)
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, h int, item_id string")
    got = {(r.doc_id, r.item_id): round(r.cover, 9) for r in decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got == want and {(102, 90), (103, 91)} <= set(got) and len(want) > 20


def test_units_of_four_languages_are_slots():
    for unit in ("ml", "km/h", "GB", "tons", "Stunden", "heures", "años", "°C"):
        words, _, slot, _ = decontam.template(f"it takes 5 {unit} now", decontam.Words())
        assert slot.tolist() == [False, False, True, True, False], (unit, words)
    assert decontam.template("it was a year", decontam.Words())[2].tolist() == [False] * 4
