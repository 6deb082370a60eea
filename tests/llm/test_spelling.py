import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.conftest import ROWS, folder
from tsumugi.llm import queries, spelling


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_distance(a, b):
    """Levenshtein, the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_groups(counts):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and plain_distance(w, x) == 1] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts), key=repr)


def variants(seed, size):
    """Words with neighbours at every kind of edit, ties in n, chains of forms, and words with equal letter counts."""
    rng = random.Random(seed)
    letters = "abefénßxÀ×÷ÿ"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 9))) for _ in range(size // 6)}
    for w in sorted(words):
        for _ in range(4):
            k = rng.randrange(len(w))
            words.add(rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    words |= {"".join(rng.sample("abcdefg", 7)) for _ in range(size // 6)} | {"kv" * 3, "kw" * 3, "kvkvkw", "kvkwkw", "vvkvkw", "a" * 300, "a" * 299}
    return {w: rng.choice([5, 5, 6, 7, 30, 31, 160, 900, 5000]) for w in words if len(w) >= 6}


@pytest.mark.parametrize("seed, cuts, most", [(1, spelling.CUTS, spelling.MOST), (2, spelling.CUTS, 3), (3, (1, 2, 5, spelling.LEVELS), 2), (4, (spelling.LEVELS,), 1)])
def test_near_words_equal_the_plain_version(spark, seed, cuts, most):
    counts = variants(seed, 400)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"]) for r in spelling.near_words(df, cuts, most).collect()}
    plain = {}
    for w, n in counts.items():
        others = [x for x in counts if abs(len(x) - len(w)) < 2 and plain_distance(w, x) == 1]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        plain[w] = (n, len(others), best, counts.get(best))
    assert found == plain


@pytest.mark.parametrize("few", [0, 1_000])
def test_leaves_of_many_words(spark, monkeypatch, few):
    """Words with equal letter counts throughout, compared one by one and by what is left without a letter."""
    monkeypatch.setattr(spelling, "FEW", few)
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("jqxyz") for _ in range(6)) for _ in range(300)})
    leaf = spelling.Leaf([(w, 5) for w in words])
    asked = [w for w in words[:60]] + [w[1:] for w in words[:60]] + [w + "j" for w in words[:60]] + ["jj" + w for w in words[:5]] + ["jjjjj", "xxxxxxx"]
    for w in asked:
        assert sorted(x for x, _ in leaf.matches(w)) == [x for x in words if plain_distance(w, x) == 1]


def test_near():
    rng = random.Random(6)
    for _ in range(4_000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(2))
        assert spelling.near(a, b) == (plain_distance(a, b) == 1)


def test_counts_of_odd_rows(spark, docs, none, monkeypatch):
    own = plain_counts([(r[0], r[1]) for r in ROWS])
    assert dict(map(tuple, spelling.word_counts(docs).collect())) == own
    monkeypatch.setattr(spelling, "HELD", 2)
    assert dict(map(tuple, spelling.word_counts(docs).collect())) == own
    assert spelling.grouped_variants(spelling.word_counts(none)).count() == 0
    text = "Größere GRÖSSERE größere÷ " * 6 + "_" + "z" * 40_000
    rows = [(1, text), (None, text), (1, text), (2, None), (3, "")]
    assert dict(map(tuple, spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == plain_counts(rows)


def test_query_over_a_table(spark, tmp_path):
    rng = random.Random(8)
    words = [(w, n % 40 + 3) for w, n in variants(7, 160).items()]
    chain = [(1_000, " ".join(["chainab"] * 6 + ["chainac"] * 35 + ["chaincc"] * 190), "en", None, 1)]
    texts = []
    for k in range(120):
        some = [w for w, n in words for _ in range(n // 20 + (rng.random() < n % 20 / 20))]
        rng.shuffle(some)
        texts.append((k * 7, " ".join(rng.choice([w, w.upper() if w.isascii() else w]) for w in some), "en", None, 1))
    rows = texts + chain + [(None, "nothing here", None, None, None), (5, None, None, None, None)]
    sf = folder(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    found = queries.op13_spelling_variants(spark, sf).collect()
    counts = plain_counts([(r[0], r[1]) for r in rows])
    plain = plain_groups(counts)
    assert sorted((tuple(r) for r in found), key=repr) == plain
    assert sum(r[1] is not None for r in plain) > 10 and any(r[1] != r[2] for r in plain if r[1])
