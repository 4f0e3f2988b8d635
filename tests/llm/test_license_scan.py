"""License scans: the alignment by its definition, and templates in the wild."""

import random
from itertools import combinations

import pytest

from corpuskit.llm.license_scan import TEMPLATES, Scanner, Template, longest_rise, patience, scan_licenses, words_of
from corpuskit.llm.queries import op2_license_scan, table

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(30))
def test_longest_rise(seed):
    rng = random.Random(seed)
    values = rng.sample(range(50), rng.randint(0, 9))
    got = [values[i] for i in longest_rise(values)]
    best = max(n for n in range(len(values) + 1) for c in combinations(values, n) if list(c) == sorted(c))
    assert got == sorted(got) and len(got) == best


@pytest.mark.parametrize("seed", range(30))
def test_patience_is_an_alignment(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 20))] for _ in range(2))
    got = patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:]))


def test_patience_by_hand():
    assert patience(list("axbyc"), list("abc")) == [(0, 0), (2, 1), (4, 2)]
    # Only the middle word is unique to both; the gaps on its sides are aligned next.
    assert patience(list("aaMbb"), list("aMb")) == [(0, 0), (2, 1), (4, 2)]
    assert len(patience(words_of(TEMPLATES["MIT"]), words_of(TEMPLATES["MIT"]))) == len(words_of(TEMPLATES["MIT"]))


def test_changed_copies_are_found():
    scanner = Scanner(TEMPLATES, 0.8)
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice(["some", "text", "the", "of", "and", "other"]) for _ in range(n))
    for name, template in TEMPLATES.items():
        words = template.split()
        for _ in range(5):
            changed = [w.upper() if rng.random() < 0.5 else w for w in words]
            plain = [i for i, w in enumerate(words) if not any(c.isdigit() for c in w) and "Attribution" not in w]
            if len(words) > 40:
                changed[rng.choice(plain)] = "CHANGED"
                changed.insert(rng.randrange(len(changed)), "added words")
            text = filler(300) + "\n" + " ".join(changed) + "\n" + filler(300)
            hit = {m[0]: m for m in scanner.scan(text)}
            assert set(hit) == {name} and hit[name][1] >= 0.8
            assert text.find(changed[0]) <= hit[name][3] < hit[name][4] <= len(text)


def test_copies_side_by_side_and_too_little():
    scanner = Scanner(TEMPLATES, 0.8)
    line = TEMPLATES["GPL-3.0-line"]
    size = len(line)
    assert scanner.scan(f"{line}\n{line}\n{line} more") == [("GPL-3.0-line", 1.0, 1.0, k * (size + 1), k * (size + 1) + size - 1) for k in range(3)]
    both = scanner.scan(f"{TEMPLATES['MIT']}\nmore text\n{TEMPLATES['MIT']}")
    assert [m[:3] for m in both] == [("MIT", 1.0, 1.0)] * 2
    assert scanner.scan("this work is licensed to nobody") == []
    assert scanner.scan(" ".join(TEMPLATES["MIT"].split()[:30])) == []


def names(text):
    return [m[0] for m in Scanner(TEMPLATES, 0.8).scan(text)]


def test_licenses_that_resemble_each_other_are_told_apart():
    for name, template in TEMPLATES.items():
        assert names(f"Copyright holders. {template} End of it.") == [name]
    gpl = "This work is licensed under the GNU General Public License, version {}."
    assert names(gpl.format(2)) == ["GPL-2.0-line"] and names(gpl.format(3)) == ["GPL-3.0-line"] and names(gpl.format(4)) == []
    assert names(TEMPLATES["CC-BY-SA-4.0-line"] + " " + TEMPLATES["CC-BY-4.0-line"]) == ["CC-BY-SA-4.0-line", "CC-BY-4.0-line"]
    assert names(TEMPLATES["BSD-3-Clause"].replace("copyright holder", "University")) == ["BSD-3-Clause"]


def all_patience(a, b):
    """The definition: every alignment that some choice of longest runs of anchors gives, gaps aligned in the same way."""
    if not a or not b:
        return {()}
    if a[0] == b[0]:
        return {((0, 0), *((i + 1, j + 1) for i, j in rest)) for rest in all_patience(a[1:], b[1:])}
    if a[-1] == b[-1]:
        return {(*rest, (len(a) - 1, len(b) - 1)) for rest in all_patience(a[:-1], b[:-1])}
    anchors = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == b.count(w) == 1]
    runs = [c for n in range(len(anchors), 0, -1) for c in combinations(anchors, n) if all(x[1] < y[1] for x, y in zip(c, c[1:]))]
    out = set()
    for run in [r for r in runs if len(r) == len(runs[0])]:
        found, before = {()}, (-1, -1)
        for i, j in [*run, (len(a), len(b))]:
            x, y = before[0] + 1, before[1] + 1
            gaps = {tuple((p + x, q + y) for p, q in part) for part in all_patience(a[x:i], b[y:j])}
            found = {(*had, *gap, *(((i, j),) if i < len(a) else ())) for had in found for gap in gaps}
            before = i, j
        out |= found
    return out or {()}


@pytest.mark.parametrize("seed", range(60))
def test_patience_equals_its_definition(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdefghijklmn") for _ in range(rng.randint(0, 8))] for _ in range(2))
    assert tuple(patience(a, b)) in all_patience(a, b)


def test_planted_licenses_and_nothing_else():
    rng = random.Random(8)
    filler = lambda: " ".join(rng.choice(["some", "text", "the", "of", "and", "software", "license", "version", "copyright", "2", "3"]) for _ in range(200))
    for _ in range(25):
        planted = [rng.choice(list(TEMPLATES)) for _ in range(rng.randint(0, 4))]
        text = filler()
        for name in planted:
            text += f"\n{TEMPLATES[name]}\n{filler()}"
        assert names(text) == planted


def test_rare_words_are_needed():
    for name, template in TEMPLATES.items():
        own = Template(name, words_of(template), 0.8)
        left = [w for w in own.words if w not in own.rare]
        assert len(left) < 0.8 * len(own.words)


def test_rows_of_all_kinds(spark):
    line = "All rights reserved."
    rows = [(1, None, "x"), (2, "", "x"), (3, f"é {line}", "x"), (3, "none", "y"), (None, line, "z"), (4, "word " * 200_000 + line, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, matches string")
    got = sorted(((r.id, [(m.license, m.start, m.end) for m in r.matches]) for r in scan_licenses(df).collect()), key=repr)
    found = "All-Rights-Reserved"
    assert got == sorted([(1, []), (2, []), (3, [(found, 2, 21)]), (3, []), (None, [(found, 0, 19)]), (4, [(found, 1_000_000, 1_000_019)])], key=repr)
    assert scan_licenses(df.limit(0)).count() == 0


def test_query_finds_the_license_lines(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF_DIR, "documents").collect()}
    got = {}
    for r in op2_license_scan(spark, SF_DIR).collect():
        got.setdefault(r.license, set()).add(r.doc_id)
        assert texts[r.doc_id][r.start : r.end].strip()
    for name in ("GPL-3.0-line", "All-Rights-Reserved"):
        holding = {i for i, t in texts.items() if TEMPLATES[name].lower() in t.lower()}
        assert holding and holding <= got[name]
