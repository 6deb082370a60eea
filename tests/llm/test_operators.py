import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, ROWS, folder, words
from tsumugi.llm import chat, components, decontam, fingerprints, licenses, mixing, neardup, quality, queries, substrings, tokens, urls

SF = "/root/testdata/sf0.001"


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# --- 1


def test_fingerprints(spark, docs, none):
    found = fingerprints.edited_fingerprints(docs.where("doc_id is not null")).collect()
    assert len(found) == sum(r[0] is not None for r in ROWS)
    texts = sorted(((r[0], r[1] or "") for r in ROWS if r[0] is not None), key=lambda x: (-x[0], x[1]))
    for k, (doc_id, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        assert any(r["doc_id"] == doc_id and r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() for r in found)
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add(r["fingerprint"])
    assert by_id[1] == by_id[2] and by_id[3] == by_id[4] == by_id[5] == {"0" * 32}
    assert fingerprints.edited_fingerprints(none).count() == 0
    single = fingerprints.edited_fingerprints(docs.where("doc_id = 10")).first()
    assert single["near_next"] == 1.0
    every = fingerprints.with_near(fingerprints.edited_fingerprints(docs)).collect()
    assert len(every) == len(ROWS) and all(r["near_next"] == 1.0 and r["n_near"] is None for r in every if r["doc_id"] is None)
    assert fingerprints.with_near(fingerprints.edited_fingerprints(none)).count() == 0


def test_fingerprints_of_near_texts_are_near(spark):
    found = queries.op1_fingerprints(spark, SF).toPandas()
    assert found["near_edited"].median() > 0.7 > found["near_next"].median() and (found["near_edited"] > found["near_next"]).mean() > 0.97


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(6)]
    prints = []
    for _ in range(150):
        x = rng.choice(base)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(128)
        prints.append(f"{x:032x}")
    df = spark.createDataFrame([(p,) for p in [*prints, None]], "fingerprint string")
    found = {(r["query"], r["found"]): r["distance"] for r in fingerprints.search(df, df, 3).collect()}
    own = {(a, b): d for a in set(prints) for b in set(prints) if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert found == own
    assert fingerprints.search(df.limit(0), df, 3).count() == 0 == fingerprints.search(df, df.limit(0), 3).count()
    with pytest.raises(ValueError, match="radius"):
        fingerprints.search(df, df, 16)


def plain_print(text):
    """Term by term and bit by bit: words and pairs of words, weighted by 1 + floor(log2 count), vote on 128 signed bits."""
    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % 2**64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    golden = 0x9E3779B97F4A7C15
    own = [xxhash.xxh3_64_intdigest(w.encode()) for w in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    counts = Counter([mixed(x) for x in own] + [mixed((x * golden + y) % 2**64) for x, y in zip(own, own[1:], strict=False)])
    out = ""
    for lane in (1, 2):
        votes = [0] * 64
        for term, n in counts.items():
            h = mixed((term + lane * golden) % 2**64)
            for b in range(64):
                votes[b] += n.bit_length() if h >> b & 1 else -n.bit_length()
        out += f"{sum(1 << b for b in range(64) if votes[b] > 0):016x}"
    return out


def test_fingerprints_against_a_plain_version(spark):
    """Every column of the query over all documents of the smallest tables, the search included."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, SF).collect()}
    order = sorted(docs, reverse=True)
    prints = {i: plain_print(t) for i, t in docs.items()}
    alike = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    assert sorted(found) == sorted(docs)
    for k, i in enumerate(order):
        after = order[(k + 1) % len(order)]
        n = len(docs[i]) // 3
        edited = docs[i][: len(docs[i]) - n] + docs[after][:n]
        r, other = found[i], plain_print(edited)
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(docs[i]), hashlib.sha256(edited.encode()).hexdigest(), prints[i], other)
        assert (r["near_edited"], r["near_next"]) == (alike(prints[i], other), alike(prints[i], prints[after]))
        assert r["n_near"] == (sum((int(prints[i], 16) ^ int(p, 16)).bit_count() <= fingerprints.RADIUS for p in prints.values()) if i % 20 == 0 else None)


# --- 2


def test_machine_sums_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    m = quality.Machine()
    m.w0, m.w, m.v = 0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4))
    x = np.zeros(quality.SIZE)
    x[rng.integers(0, quality.SIZE, 12)] = rng.normal(size=12)
    at = np.flatnonzero(x)
    pairs = sum((m.v[i] @ m.v[j]) * x[i] * x[j] for i, j in combinations(at, 2))
    assert np.isclose(m.logits(x[None])[0], m.w0 + m.w @ x + pairs)


def test_quality(spark, docs, none):
    found = queries.op2_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert [bool(x) for x in found["held_out"]] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found["doc_id"]]
    held = found[found["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9 and found["score"].between(0, 1).all()
    labels = spark.createDataFrame([(1, 1), (None, 1), (6, None)], "doc_id long, quality int")
    machine = quality.fit(docs, labels)
    scores = quality.score_documents(docs, machine, ["doc_id"]).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
    empty = quality.fit(none, labels.limit(0))
    assert quality.score_documents(none, empty, ["doc_id"]).count() == 0 and empty.scores(["x", None])[0] == pytest.approx(0.5)


def test_scores_against_a_plain_version():
    """Feature by feature, in a loop over all pairs, on the machine's own scale."""
    machine, rng = quality.Machine(), np.random.default_rng(5)
    machine.w0, machine.w = -0.2, rng.normal(0, 0.3, quality.SIZE).astype(np.float32)
    machine.v = rng.normal(0, 0.2, machine.v.shape).astype(np.float32)
    for text in ("", None, "One two. Two THREE!\n\none two", "x " * 500):
        x = quality.features(text).astype(float)
        own = words((text or "").lower())
        counts = Counter(xxhash.xxh3_64_intdigest(w.encode()) % quality.BUCKETS for w in own)
        hashed = np.array([np.log1p(counts[b]) for b in range(quality.BUCKETS)])
        assert np.allclose(x[: quality.BUCKETS], hashed / max(1e-9, np.sqrt((hashed**2).sum())), atol=1e-5)
        x[quality.BUCKETS :] = np.clip((x[quality.BUCKETS :] - machine.mean) / machine.scale, -4, 4) / 4
        at = np.flatnonzero(x)
        total = machine.w0 + sum(machine.w[i] * x[i] for i in at) + sum(float(machine.v[i] @ machine.v[j]) * x[i] * x[j] for i, j in combinations(at, 2))
        assert np.isclose(machine.scores([text])[0], 1 / (1 + np.exp(-np.clip(total, -30, 30))), atol=1e-4)


def test_held_out_labels_are_ranked(spark):
    """On held-out rows: the area under the curve, and more right than the commoner label alone gives."""
    sf = "/root/testdata/sf0.01"
    found = queries.op2_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good, bad = found[found["quality"] == 1]["score"].to_numpy(), found[found["quality"] == 0]["score"].to_numpy()
    assert len(good) > 20 and len(bad) > 3
    area = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert area > 0.97 and (found["predicted"] == found["quality"]).mean() > max(found["quality"].mean(), 1 - found["quality"].mean()) + 0.05


# --- 3


def test_filter_rules():
    """Filter texts by what they mean, written out."""
    fits = {"||ads.example.com^": ["ads.example.com/x", "m.ads.example.com", "ads.example.com:80/"], "|http": [], "/banner/*/img^": ["a.org/banner/1/img", "a.org/banner//img/x"], "swf|": ["a.org/x.swf"], "-ad-": ["a.org/x-AD-y"], "*": ["", "a.org"], "a^b": ["x/a/b"]}
    fails = {"||ads.example.com^": ["xads.example.com/", "ads.example.community", "a.org/ads.example.com"], "/banner/*/img^": ["a.org/banner/img", "a.org/banner/1/imgs"], "swf|": ["a.swf/x"], "-ad-": ["a.org/x-ads-y"], "a^b": ["x/ab", "a.b"]}
    for text, given in fits.items():
        rule = urls.filter_rule(text, "block")
        for u in given:
            assert re.search(rule.pattern, u.lower(), re.DOTALL), (text, u)
            assert set(rule.tokens) <= set(re.findall(urls.TOKEN, u.lower())), (text, u)
    for text, given in fails.items():
        assert not any(re.search(urls.filter_rule(text, "block").pattern, u, re.DOTALL) for u in given), text
    assert urls.filter_rule("||ads.example.com^", "block").tokens == ("ads", "example", "com") and urls.filter_rule("swf|", "block").tokens == ()


def test_thousands_of_rules_from_a_table(spark):
    """The index against every rule run on every URL."""
    rng = random.Random(6)
    part = [f"{a}{b}" for a in ("ad", "shop", "news", "pix", "z") for b in range(60)]
    rows = [(f"{rng.choice(part)}.{rng.choice(('com', 'net', 'org'))}", f"/{rng.choice(part)}"[: rng.randrange(8)], None, rng.choice(("allow", "block"))) for _ in range(1500)]
    shapes = ("||{0}.com^", "/{0}/*{1}", "-{0}.", "|{0}.net/", "{0}|", "{0}*{1}^", ".{0}/{1}/")
    rows += [(None, None, rng.choice(shapes).format(rng.choice(part), rng.choice(part)), rng.choice(("allow", "block"))) for _ in range(2500)] + [(None, None, None, "block"), ("x.com", None, None, None), (None, None, "", "block")]
    rules = urls.read_rules(spark.createDataFrame(rows * 2, "host string, path string, pattern string, verdict string"))
    assert 3000 < len(rules) < 4001
    given = [f"https://{rng.choice(part)}.{rng.choice(part)}.{rng.choice(('com', 'net', 'org'))}/{rng.choice(part)}/{rng.choice(part)}{rng.choice(('', '-' + rng.choice(part) + '.x', '?q'))}" for _ in range(300)]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(given)], "page_id int, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(df, ["page_id"], sites=tuple(r for r in rules if r.name), patterns=tuple(r for r in rules if not r.name)).collect()}
    for k, u in enumerate(given):
        full = "".join(urls.split_url(u))
        own = [(r.length, r.verdict, r.name) for r in rules if r.name and re.search(r.pattern, full, re.DOTALL)]
        blocked = any(r.name is None and r.verdict == "block" and re.search(r.pattern, full.lower(), re.DOTALL) for r in rules)
        assert found[k] == ((max(own)[2], max(own)[1]) if own else (None, "block" if blocked else "allow")), u
    assert {v for _, v in found.values()} == {"allow", "block"}


def test_urls(spark):
    given = {
        "http://a.com": (("a.com", ""), None, "allow"), "http://A.com/x": (("a.com", "/x"), "com/", "allow"), "https://example.com/en/1": (("example.com", "/en/1"), "example.com/en/", "block"),
        "https://m.example.com/EN/1": (("m.example.com", "/EN/1"), "com/", "allow"), "https://www.example.com/en/?q": (("www.example.com", "/en/"), "www.example.com/en/", "allow"),
        "https://notexample.com/en/": (("notexample.com", "/en/"), "com/", "allow"), "x://b.net/es/#t": (("b.net", "/es/"), "net/es/", "block"), "x://net/fr/": (("net", "/fr/"), "net/fr/", "block"),
        "x://b.net/esp": (("b.net", "/esp"), None, "allow"), "http://spam-farm.example.org/a": (("spam-farm.example.org", "/a"), None, "block"), "http://adult-x.b.org": (("adult-x.b.org", ""), None, "block"), "http://b.org/ads/adult": (("b.org", "/ads/adult"), None, "allow"), "no url": (("", ""), None, "allow"), None: (("", ""), None, "allow"), "": (("", ""), None, "allow"),
    }
    df = spark.createDataFrame([(k, u) for k, u in enumerate(given)], "page_id int, url string")
    found = rows_of(urls.filter_urls(df, ["page_id"]), "page_id")
    assert [((h, p), r, v) for _, h, p, r, v in found] == list(given.values())
    assert urls.filter_urls(df.limit(0), ["page_id"]).count() == 0
    index = urls.Index((*urls.SITE_RULES, *urls.PATTERN_RULES), {"com": 100, "example": 10, "en": 50})
    plain = urls.Index(tuple(r._replace(tokens=()) for r in (*urls.SITE_RULES, *urls.PATTERN_RULES)), {})
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect():
        assert index.judge(r["url"]) == plain.judge(r["url"])


def test_joined_words_are_blocked():
    """Two-word patterns whose words are one token, against an index without tokens."""
    pairs = {"spam": ["farm", "farm7"], "link": ["farm", "farm2024"], "cheap": ["pill", "pills"], "online": ["casino", "pharmacy", "poker"], "free": ["porn", "xxx", "sex"], "adult": ["cam", "cams", "chat", "video", "videos"], "payday": ["loan", "loans"], "click": ["bait"]}
    index = urls.Index(urls.PATTERN_RULES, {"spam": 9, "clickbait": 5, "online": 1})
    plain = urls.Index(tuple(r._replace(tokens=()) for r in urls.PATTERN_RULES), {})
    for a, ends in pairs.items():
        for mark in ("", "-", "_"):
            for b in ends:
                for given in (f"x://{a}{mark}{b}.org", f"x://m.{a}{mark}{b}-9.net/p", f"x://a.org/q-{a.upper()}{mark}{b}"):
                    assert index.judge(given)[3] == plain.judge(given)[3] == "block", given
                for given in (f"x://x{a}{mark}{b}.org", f"x://a.org/{a}{mark}{b}x"):
                    assert index.judge(given) == plain.judge(given), given
    assert index.judge("x://xspamfarm.org")[3] == index.judge("x://a.org/spamfarmx")[3] == "allow"
    assert index.judge("x://spamfarm\u0663.org")[3] == "allow"


# --- 4


def print_of(text):
    own = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, radius):
    """The smallest id that each id reaches over links."""
    least = {i: i for i, _ in prints}
    links = [(a, b) for (a, x), (b, y) in combinations(prints, 2) if (x ^ y).bit_count() <= radius]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


@pytest.mark.parametrize("most", [neardup.MOST, 3])
def test_simhash_near_dedup(spark, docs, tmp_path, monkeypatch, most):
    """The second size sends every bucket of over three rows by way of the neighbours."""
    monkeypatch.setattr(neardup, "MOST", most)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120)
    more = [(10_000 + k, r["text"] + " x" * (k % 2)) for k, r in enumerate(base.limit(40).collect())]
    rows = [(r["doc_id"], r["text"]) for r in base.collect()] + more + [(20_000, None), (20_001, ""), (20_002, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash_near_dedup(spark, folder(spark, tmp_path, documents=df)).collect()}
    prints = [(i, print_of(t)) for i, t in rows]
    least = reachable(prints, 2)
    assert found == {i: (f"{p:016x}", least[i]) for i, p in prints}


def test_neighbours_find_all_links(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(60)]
    df = spark.createDataFrame([(k, p.to_bytes(8, "big")) for k, p in enumerate(prints)], "a long, print binary")
    links = neardup.near_by_neighbours(df)
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    assert {k: roots.get(k, k) for k in range(60)} == reachable(list(enumerate(prints)), 2)


def test_near_groups_edges(spark, docs, none):
    for method in (neardup.Blocked(), neardup.Banded()):
        found = neardup.near_groups(docs, method)
        assert found.count() == len(ROWS)
        by_id = defaultdict(set)
        for r in found.collect():
            by_id[r["doc_id"]].add(r["component_id"])
        assert by_id[1] == by_id[2] == {1} and by_id[3] == by_id[4] == by_id[5] == {3} and by_id[6] == by_id[7] == {6}
        assert by_id[None] == {3, None}
        kept = neardup.keep_one_each(docs, found)
        assert kept.columns == docs.columns
        ids = Counter(r["doc_id"] for r in kept.collect())
        assert ids[1] == ids[3] == ids[6] == 1 and not ids[2] and not ids[4] and not ids[7] and ids[None] == 1 and ids[9] == 1
        assert neardup.near_groups(none, method).count() == 0


def test_wide_fingerprints_follow_similarity(spark):
    rng = random.Random(1)
    vocabulary = [f"v{k}" for k in range(5000)]
    texts = []
    for k in range(12):
        own = [rng.choice(vocabulary) for _ in range(400)]
        texts.append((3 * k, " ".join(own)))
        near = own[:200] + ["changed"] + own[201:]
        texts.append((3 * k + 1, " ".join(near)))
        far = own[:200] + [rng.choice(vocabulary) for _ in range(200)]
        texts.append((3 * k + 2, " ".join(far)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(df, neardup.Banded()).collect()}
    assert found == {i: i - (i % 3 == 1) for i, _ in texts}


def shingled(own):
    return {tuple(own[k : k + 5]) for k in range(len(own) - 4)} or {tuple(own)}


def alike(a, b):
    return len(shingled(a) & shingled(b)) / len(shingled(a) | shingled(b))


@pytest.mark.parametrize("n_words", [10, 20, 50, 400])
def test_recall_of_near_copies(n_words):
    """Pairs of similarity 0.8 to 0.85 (words left out, put in or changed): in a bucket of both and within the radius."""
    rng, method, tried, linked = random.Random(n_words), neardup.Banded(), 0, 0
    while tried < 200:
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(n_words, n_words + n_words // 5))]
        other = list(own)
        for _ in range(rng.randint(1, max(1, n_words // 40))):
            at, how = rng.randrange(len(other) + 1), rng.randrange(3)
            other[at : at + (how != 1)] = [f"x{rng.randrange(10**6)}"] * (how > 0)
        if not 0.8 <= alike(own, other) < (0.85 if n_words > 20 else 0.9):
            continue
        tried += 1
        (p, k, m), (q, j, n) = method.describe(" ".join(own)), method.describe(" ".join(other))
        linked += bool(set(k) & set(j)) and (int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_count() <= method.radii[min(m, n)]
    assert linked / tried >= 0.9


def test_share_of_bits_is_counted():
    rng = np.random.default_rng(3)
    for a, b, c in ((4, 5, 4), (6, 7, 6), (30, 33, 28)):
        coins = rng.integers(0, 2, (200_000, a + b - c))
        one, two = coins[:, :a].sum(axis=1) * 2 > a, np.c_[coins[:, :c], coins[:, a:]].sum(axis=1) * 2 > b
        assert abs((one != two).mean() - neardup.share_of_bits(a, b, c)) < 0.005


@pytest.mark.parametrize("changed", [4, 5])
def test_a_cluster_of_variants_has_the_same_groups_at_any_size(spark, monkeypatch, changed):
    """Variants of one text, most in one bucket: the same groups with pieces of 64 and 512 rows and without pieces."""
    rng = random.Random(changed)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(1300):
        own = list(base)
        for at in rng.sample(range(200), changed):
            own[at] = f"c{rng.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = []
    for most in (64, 512, 1 << 20):
        monkeypatch.setattr(neardup, "MOST", most)
        found.append({r["doc_id"]: r["component_id"] for r in neardup.near_groups(df, neardup.Banded()).collect()})
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("most", [neardup.MOST, 3, 17])
def test_large_buckets_lose_no_link(spark, monkeypatch, most):
    """Chains of fingerprints in one bucket, of which only neighbours are near: links don't depend on the size of a piece."""
    monkeypatch.setattr(neardup, "MOST", most)

    class OneBucket(neardup.Banded):
        def __init__(self):
            self.lanes, self.radii = 1, np.array([5])

        def describe(self, text):
            return int(text).to_bytes(8, "big"), [7 if int(text) else 8], 0

    rng = random.Random(11)
    prints = [0]
    for _ in range(8):
        x = rng.getrandbits(64)
        bits = rng.sample(range(64), 60)
        for k in range(12):  # each link flips five bits of its own
            prints.append(x := x ^ sum(1 << b for b in bits[5 * k : 5 * k + 5]))
    ids = rng.sample(range(1000), len(prints))
    least = reachable(list(zip(ids, prints, strict=True)), 5)
    df = spark.createDataFrame([(i, str(p)) for i, p in zip(ids, prints, strict=True)], "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_groups(df, OneBucket()).collect()} == least
    assert len(set(least.values())) == 9


def test_buckets_against_brute_force():
    rng = np.random.default_rng(0)
    for lanes, radius in ((1, 2), (4, 45)):
        base = rng.integers(0, 2**63, (20, lanes), dtype=np.uint64)
        prints = base[rng.integers(0, 20, 700)]
        for k in range(700):
            for _ in range(rng.integers(0, 2 * radius)):
                prints[k, rng.integers(lanes)] ^= np.uint64(1) << np.uint64(rng.integers(64))
        bucket = np.sort(rng.integers(0, 30, 700))
        labels = np.arange(700)
        for i in range(700):
            near = np.flatnonzero((np.bitwise_count(prints[i] ^ prints).sum(axis=1) <= radius) & (bucket == bucket[i]))
            labels = neardup.unite(labels, np.full(len(near), i), near)
        assert (neardup.bucket_roots(prints, bucket, np.zeros(700, np.int64), np.array([radius])) == labels).all()


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 101), (200, 199)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame([*path, (None, 3)], "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 199: 199, 200: 199}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 5


def simulated(blocks, weights, parts):
    """Slot by slot: at each slot the released block with the earliest deadline, all numbers as fractions."""
    left, order = {s: n for s, n in blocks.items() if n}, []
    while left:
        own = {s: weights[s] for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1.0)
        share = mixing.shares(own, parts)
        size, done, slot = sum(share.values()), dict.fromkeys(own, 0), 0
        while all(left[s] for s in own):
            ready = [(-(-(done[s] + 1) * size // share[s]), s) for s in own if done[s] * size // share[s] <= slot]
            _, s = min(ready)
            done[s], left[s], slot = done[s] + 1, left[s] - 1, slot + 1
            order.append(s)
            for t in own:
                assert abs(done[t] * size - slot * share[t]) < size  # less than one block of deviation
        left = {s: n for s, n in left.items() if n}
    return order


@pytest.mark.parametrize(("blocks", "weights"), [({"a": 30, "b": 7, "c": 50}, {"a": 0.5, "b": 0.3, "c": 0.2}), ({"a": 1, "b": 1}, {"a": 1.0}), ({"x": 9}, {}), ({"a": 40, "b": 40, "c": 40}, {"a": 1e-9, "b": 1, "c": 1})])
def test_schedule(blocks, weights):
    plan = mixing.schedule(blocks, weights, 100)
    slots = {}
    for s, phases in plan.items():
        assert sum(p.n for p in phases) == blocks[s]
        for p in phases:
            k = np.arange(p.n)
            for x in (p.base + k // len(p.slots) * p.size + p.slots[k % len(p.slots)]).tolist():
                assert x not in slots
                slots[x] = s
    assert sorted(slots) == list(range(sum(blocks.values())))
    assert [slots[k] for k in sorted(slots)] == simulated(blocks, weights, 100)


def test_mixing(spark, docs, none):
    found = mixing.mix_sources(docs, block=2).collect()
    assert len(found) == len(ROWS) and len({r["mix_order"] for r in found}) == len(ROWS)
    assert Counter(r["source"] for r in found) == Counter(r[3] for r in ROWS)
    for r in found:
        assert r["mix_order"] == int(r["slot"]) * 2 + r["place"] and r["place"] < 2
    again = {(r["doc_id"], r["text"]): r["slot"] for r in mixing.mix_sources(docs.repartition(5), block=2).collect() if r["doc_id"] in (1, 6, 7, 10)}
    assert again == {(r["doc_id"], r["text"]): r["slot"] for r in found if r["doc_id"] in (1, 6, 7, 10)}
    assert mixing.mix_sources(none).count() == 0


def test_mixing_of_very_many_sources(spark, monkeypatch):
    """Sources beyond the number of places share one, with their weights together, in the order of their deadlines."""
    monkeypatch.setattr(mixing, "PLACES", 5)
    rows = [(k, f"t{k}", f"s{k % 40}" if k < 400 else f"big{k % 4}") for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(df, block=4).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(1200)) and len({r["mix_order"] for r in found}) == 1200
    place = lambda s: s if s.startswith("big") else "shared"
    weights = {f"big{k}": 200**0.5 for k in range(4)} | {"shared": 40 * 10**0.5}
    blocks = {p: -(-n // 4) for p, n in Counter(place(r["source"]) for r in found).items()}
    names = {s: ("=" + s if s != "shared" else "+") for s in blocks}
    order = simulated({names[s]: n for s, n in blocks.items()}, {names[s]: w for s, w in weights.items()}, mixing.PARTS)
    assert {(r["slot"], names[place(r["source"])]) for r in found} == set(enumerate(order))
    for r in found:
        assert r["place"] < 4 and (place(r["source"]) != "shared" or r["weight"] < 0.02)
    shared = [r["source"] for r in sorted(found, key=lambda r: r["mix_order"]) if place(r["source"]) == "shared"]
    for k in range(10):  # sources of equal weight take turns
        assert len(set(shared[40 * k : 40 * k + 40])) == 40
    some = mixing.mix_sources(df, weights={"s0": 3.0, "big1": 1.0}, block=4).collect()
    assert len({r["mix_order"] for r in some}) == 1200 and {r["source"] for r in sorted(some, key=lambda r: r["mix_order"])[:13]} == {"s0", "big1"}


# --- 6


def test_licenses(spark, docs, none):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and t.startswith("Permission"))
    rows = [(1, "a\nReleased under the MIT license\nb"), (2, mit.replace(", ", ",\n")), (3, "LICENSED under the apache license version 2.0"), (4, "This work is licensed under the GNU General Public License, version 2."), (5, "nothing of the kind here at all"), (6, None), (7, ""), (None, "Released under the MIT License."), (1, "a\nReleased under the MIT license\nb")]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["license"]): (r["n_passages"], r["first_line"], round(r["dice"], 3)) for r in found.collect()} == {(1, "MIT"): (1, 1, 1.0), (2, "MIT"): (0, -1, 1.0), (3, "Apache-2.0"): (1, 0, 1.0), (4, "GPL-2.0"): (1, 0, 1.0), (None, "MIT"): (1, 0, 1.0)}
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(none).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_notices_inside_paragraphs(spark):
    """A notice among other sentences of its line, after a copyright, over a line end within paragraphs, and twice in a line."""
    story = "Once there was a fox. It ran over the hills and far away! Nobody saw it again?"
    mpl = next(t for n, t in licenses.TEMPLATES if n == "MPL-2.0")
    rows = [
        (1, f"{story} Released under the MIT License. {story}"), (2, f"{story}\n(c) 2020 Some One. Licensed under CC BY 4.0."), (3, f"{story} {mpl[:40]}\n{mpl[40:]} {story}"),
        (4, f"x y z\nReleased under the MIT License. Then more. Licensed under CC BY-SA 4.0. {story}"), (5, f"{story} The MIT License is not what this is about, nor is it released."), (6, "Released under the MIT License. " * 3),
    ]
    found = {(r["doc_id"], r["license"]): (r["n_passages"], r["first_line"], r["dice"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, "MIT"): (1, 0, 1.0), (2, "CC-BY-4.0"): (1, 1, 1.0), (3, "MPL-2.0"): (1, 0, 1.0), (4, "MIT"): (1, 1, 1.0), (4, "CC-BY-SA-4.0"): (1, 1, 1.0), (6, "MIT"): (3, 0, 1.0)}


def test_recall_of_planted_notices(spark):
    """Every template and full text, alone on a line, wrapped, or inside a paragraph, within a longer document."""
    rng = random.Random(9)
    names = [f"n{k}" for k in range(500)]
    prose = lambda n: " ".join(" ".join(rng.choice(names) for _ in range(9)) + "." for _ in range(n))
    rows, wanted = [], {}
    for k, (name, text) in enumerate((*licenses.TEMPLATES, *licenses.FULL_TEXTS)):
        for way in range(3):
            given = "\n" + text + "\n" if way == 0 else "\n" + "\n".join(textwrap.wrap(text, 50)) + "\n" if way == 1 else " " + text + " "
            rows.append((3 * k + way, prose(20) + given + prose(20)))
            wanted[3 * k + way] = name
    found = defaultdict(set)
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["doc_id"]].add(r["license"])
    assert sum(wanted[k] in found[k] for k in wanted) / len(wanted) > 0.97


def test_wrapped_licenses(spark):
    """Notices over several lines of longer documents, and license files; every run of lines compared by hand."""
    filler = [f"line {k} of a story about w{k % 37} and w{k % 11}" for k in range(200)]
    texts = dict(licenses.FULL_TEXTS)
    long = {n: max((t for m, t in licenses.TEMPLATES if m == n), key=len) for n, _ in licenses.TEMPLATES}
    wrapped = lambda text, width=60: textwrap.wrap(text, width)
    rows = {}
    for k, name in enumerate(("MIT", "ISC", "GPL-3.0", "GPL-2.0", "Apache-2.0", "BSD-2-Clause")):
        rows[k] = (name, 50, filler[:50] + wrapped(long[name]) + filler[50:])
    for k, name in enumerate(texts):
        rows[10 + k] = (name, 4, [f"{name} License", "", "Copyright (c) 2020 Some One", ""] + wrapped(texts[name], 76))
        rows[20 + k] = (name, 200, filler + wrapped(texts[name], 40) + filler)
    shared = textwrap.wrap("# " + long["ISC"] + " " + long["GPL-3.0"], 70)
    df = spark.createDataFrame([(k, "\n".join(lines)) for k, (_, _, lines) in rows.items()] + [(40, "\n".join(filler + shared)), (41, "\n".join(["Released under the MIT License."] * 300))], "doc_id long, text string")
    found = defaultdict(dict)
    for r in licenses.scan_licenses(df).collect():
        found[r["doc_id"]][r["license"]] = (r["n_passages"], r["first_line"], r["dice"])
    for k, (name, line, lines) in rows.items():
        n, first, dice = found[k].pop(name)
        assert (n, first, found[k]) == (1, line, {}) or (k in range(10, 20) and (n, first, found[k]) == (0, -1, {})), (k, name)
        assert dice == pytest.approx(1.0) if k < 10 else dice > 0.9
    assert set(found[40]) == {"ISC", "GPL-3.0"} and found[41] == {"MIT": (300, 0, 1.0)}


def test_runs_of_lines_against_brute_force(spark):
    rng = random.Random(6)
    pairs_of = lambda text: {*zip(w := re.findall("[a-z0-9]+", text.lower()), w[1:], strict=False)}
    given = [("X", "a b c d e f g h"), ("Y", "e f g h a b a c"), ("Z", "a b a b c")]
    rows = [(k, "".join(rng.choice(["a b", "c", "d e", "f g h", "x", "e f", "", "b a c"]) + rng.choice([" ", "\n", "\n"]) for _ in range(rng.randrange(2, 14)))) for k in range(150)]
    wanted, whole = defaultdict(set), set()
    for k, text in rows:
        lines = text.split("\n")
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                own = pairs_of("\n".join(lines[i : j + 1]))
                for t, (_, template) in enumerate(given):
                    b = pairs_of(template)
                    if own and 2 * len(own & b) / (len(own) + len(b)) >= 0.8 - 1e-9:
                        wanted[k, t].add((i, j, len(own & b), len(own)))
        own = pairs_of(text)
        whole |= {(k, t) for t, (_, x) in enumerate(given) if len(lines) > 1 and own and 2 * len(own & pairs_of(x)) / (len(own) + len(pairs_of(x))) >= 0.8 - 1e-9}
    near = licenses.near_passages(spark.createDataFrame(rows, "doc_id long, text string"), tuple(given), 0.8).collect()
    near = [r for r in near if 2 * r["run"]["c"] / (r["run"]["n"] + r["size"]) >= 0.8 - 1e-9]
    found = defaultdict(set)
    for r in near:
        if r["run"]["s"] >= 0:
            found[r["doc_id"], r["template"]].add((r["run"]["s"], r["run"]["e"], r["run"]["c"], r["run"]["n"]))
    assert {(r["doc_id"], r["template"]) for r in near if r["run"]["s"] < 0} == whole and whole
    assert set(found) == set(wanted) and len(found) > 20
    for key, runs in wanted.items():
        assert found[key] <= runs
        for i, j, c, n in runs:  # a run that isn't there holds one that is as near
            assert any(i <= s and e <= j and x == c and y <= n for s, e, x, y in found[key])


# --- 7


def contained_by_hand(texts, items):
    out = {}
    for d, t in texts:
        own = decontam.words_of(t)
        for i, item in items:
            asked = decontam.words_of(item)
            n = min(5, len(asked))
            wanted = decontam.shingle_set(asked, n) if asked else set()
            shared = len(wanted & decontam.shingle_set(own, n)) if n else 0
            if wanted and 5 * shared >= 4 * len(wanted):
                out[d, i] = (shared, len(wanted))
    return out


def best_by_hand(pairs):
    of = defaultdict(list)
    for (d, i), (shared, n) in pairs.items():
        of[d].append((-shared / n, i, shared, n))
    return {d: (len(x), *min(x)[1:]) for d, x in of.items()}


def test_many_items_in_many_texts(spark, monkeypatch):
    """Items and texts that all share one passage: a row a text, whatever the number of pairs, and no text once for each."""
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 4_000)
    passage = [f"p{k}" for k in range(20)]
    items = [(k, " ".join([*passage, f"i{k}"])) for k in range(300)]
    texts = [(k, " ".join([f"t{k}", *passage, f"i{k % 7}", "end"])) for k in range(200)] + [(k, "something else of more than five words") for k in range(200, 220)]
    t, i = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: (r["n_items"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontam.contaminated(t, i).collect()}
    assert found == {k: (300, k % 7, 17, 17) for k in range(200)}
    assert {r["doc_id"] for r in decontam.decontaminate(t, i).collect()} == set(range(200, 220))


@pytest.mark.parametrize("role", ["user\nsystem", "\n", "a<|newline|>b\n<\\|newline|>", "<|im_start|>\n\n<", "", "user"])
def test_roles_with_line_ends_are_read_back(role):
    for text in ("hi", "\nhi", "<|newline|>", ""):
        formatted, begin, end, _, _ = chat.format_turn(role, text, (role,))
        assert chat.read_turn(formatted) == (role, text) and chat.unescape(formatted[begin:end]) == text


def test_a_common_passage_makes_no_pairs(spark):
    """Every text may contain every item: what is stored follows the texts and the blocks, and items of equal shingles are one class."""
    passage = " ".join(f"shared{k}" for k in range(40))
    items = [(k, f"{passage} own{k} tail{k}") for k in range(300)] + [(1_000 + k, passage) for k in range(50)] + [(1_000, f"{passage} again"), (7, f"{passage} own7 tail7")]
    texts = [(k, f"before{k} {passage} after{k}") for k in range(300)] + [(900, passage + " own7 tail7"), (901, "other words of another text altogether here")]
    t, i = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    _, reached = decontam.suspects(t, i, 5, 0.8)
    assert reached.count() == 301
    found = {r["doc_id"]: (r["n_items"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontam.contaminated(t, i).collect()}
    assert found == {k: (350, 1_000, 36, 36) for k in range(300)} | {900: (350, 7, 38, 38)}


def test_decontamination(spark, docs, none, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 30, 70])))) for k in range(40)]
    texts = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 50, 2000])))) for k in range(60)]
    for k in range(40):
        own = items[k][1].split()
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = "changed"
        before, _, after = texts[k][1].partition(" ")
        texts[k] = (k, before + " " + ", ".join(own).upper() + " " + after)
    t, i = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*items, (None, "x"), (99, None), (98, " ")], "item_id long, text string")
    found = {r["doc_id"]: (r["n_items"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontam.contaminated(t, i).collect()}
    own = contained_by_hand(texts, items)
    assert found == best_by_hand(own) and len(own) > 20
    left = {r["doc_id"] for r in decontam.decontaminate(t, i).collect()}
    assert left == {d for d, _ in texts} - {d for d, _ in own}
    assert decontam.contaminated(none, i).count() == 0 and decontam.contaminated(t, i.limit(0)).count() == 0
    kept = decontam.decontaminate(docs, spark.createDataFrame([(0, "no id here no id here no")], "item_id long, text string"))
    assert kept.count() == len(ROWS) - 1 and kept.columns == docs.columns


# --- 8


def test_token_counts(spark, docs, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(0)
    texts = ["", " ", "  a  b ", "<s></s><0x0A><unk>", "日本語。漢字", "a\r\nb();\r\n\t\tx", "▁x▁ y▁▁", "x" * 3000, "ab" * 2000, "aaa" * 700, "\x00😀é́", *["".join(rng.choice("abcthe ing\n▁ é日{}();=\r\t01") for _ in range(300)) for _ in range(60)]]
    assert tokens.Merges(path).counts(texts) == [len(model.encode(t)) for t in texts]
    found = tokens.count_tokens(docs, path, ["doc_id"]).collect()
    assert Counter((r["n_bytes"], r["n_tokens"]) for r in found) == Counter((len((t or "").encode()), len(model.encode(t or ""))) for _, t, *_ in ROWS)
    assert tokens.count_tokens(none, path, ["doc_id"]).count() == 0


# --- 9


def removed_by_hand(rows, window=50):
    seen, out = {}, {}
    for i, t in sorted(rows):
        own, gone = words(t), set()
        mine = set()
        for s in range(len(own) - window + 1):
            k = tuple(own[s : s + window])
            gone.update(range(s, s + window)) if seen.get(k, i) < i else mine.add(k)
        for k in mine:
            seen.setdefault(k, i)
        out[i] = (len(own), len(gone), " ".join(w for j, w in enumerate(own) if j not in gone))
    return out


def test_suffix_arrays_against_brute_force():
    """Sorted suffixes, common prefixes and deep nodes of groups of texts, with repeats within and across them."""
    rng = random.Random(4)
    for window in (1, 3, 5):
        texts, group = [], []
        for g in range(6):
            base = [b"abc"[k : k + 1] for k in (rng.randrange(3) for _ in range(30))]
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(20)
                texts.append(base[at : at + rng.randint(window, 12)] if rng.random() < 0.7 else [rng.choice([b"a", b"b"]) for _ in range(window + 3)])
                group.append(g)
        texts, group = zip(*((t, g) for t, g in zip(texts, group, strict=True) if len(t) >= window), strict=True)
        text, place, common = substrings.suffix_array(list(texts), list(group), window)
        assert sorted(zip(text.tolist(), place.tolist(), strict=True)) == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - window + 1)]
        suffixes = [(group[k], texts[k][i:]) for k, i in zip(text.tolist(), place.tolist(), strict=True)]
        order = {}  # the words' own order is that of their first appearance
        for t in texts:
            for w in t:
                order.setdefault(w, len(order))
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1]))) if a[0] == b[0] else 0
        assert common.tolist() == [0] + [shared(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        node = substrings.deep_nodes(common, window).tolist()
        for i, a in enumerate(suffixes):
            for j, b in enumerate(suffixes):
                assert (node[i] == node[j]) == (i == j or shared(a, b) >= window)


@pytest.mark.parametrize("most", [substrings.MOST, 1, 4])
def test_substring_dedup(spark, tmp_path, monkeypatch, most):
    """The second size splits every group by the whole window."""
    monkeypatch.setattr(substrings, "MOST", most)
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(30)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 120)] + [["la"] * 130, (["a", "b", "c"] * 60)]
    rows = []
    for k in range(40):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([0, 20, 90]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(own) + 1)
            own[at:at] = rng.choice(passages)
        rows.append((k, " \n".join(own)))
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substrings.dedup_substrings(df).collect()}
    assert found == removed_by_hand(rows)
    laid = {r["doc_id"]: r["text"] for r in substrings.dedup_substrings(df, layout=True).collect()}
    for i, t in rows:
        assert words(laid[i]) == found[i][2].split() and (found[i][1] or laid[i] == t)


def test_substring_dedup_edges(spark, docs, none):
    found = substrings.dedup_substrings(docs).collect()
    assert len(found) == len(ROWS) and [c for c in found[0].__fields__ if c not in ("n_words", "n_removed")] == [c for c in docs.columns if c != "n_words"]
    by_id = defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].append((r["n_words"], r["n_removed"]))
    n = len(words(ROWS[0][1]))
    # a text that repeats itself, but no smaller doc_id, stays
    assert by_id[1] == [(n, 0)] and by_id[2] == [(n, n)] * 2 and by_id[6] == [(60_000, 0)] and by_id[7] == [(60_001, 60_000)]
    assert by_id[4] == [(0, 0)] and sorted(by_id[None]) == [(0, 0), (60, 0)]
    assert substrings.dedup_substrings(none).count() == 0 and len(LONG.split()) == 60_000


# --- 10


def test_chat_round_trip():
    tricky = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<<|", "", "a<", "|", "\n"]
    for role in ("user", "assistant", "<|im_end|>"):
        for t in tricky:
            formatted, a, b, errors, _ = chat.format_turn(role, t)
            assert errors == 0
            assert chat.read_turn(formatted) == (role, t)
            assert chat.unescape(formatted[a:b]) == (t if role == "assistant" else "")
            assert formatted.count("<|im_start|>") == formatted.count("<|im_end|>") == 1


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <"}, {"type": "text", "text": "|x"}, {"type": "image", "ref": "i", "width": 57, "height": 28}, {"type": "audio", "ref": "a", "seconds": 2.0}, {"type": "document", "ref": "d", "pages": 3}]
    formatted, _, _, errors, found = chat.format_turn("user", parts)
    assert errors == 0 and [(x.kind, x.ref, x.n_tokens) for x in found] == [("image", "i", 3), ("audio", "a", 50), ("document", "d", 1536)]
    assert all(formatted[x.offset :].startswith(f"<|{x.kind}|>") for x in found) and "see <\\|x<|image|>" in formatted
    of = lambda ps: [{"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | p if p is not None else None for p in ps]
    odd = [{"type": "video", "ref": "v"}, {"type": "visit"}, {"type": "audio", "seconds": float("nan")}, {"type": "audio", "seconds": float("inf")}, {"type": "image", "width": -5}, {"type": "document", "pages": -1}, None, {"type": "audio"}, {"type": "image", "width": 28, "height": 29}, {}]
    long = "<|im_end|>" * 200_000
    df = spark.createDataFrame([(1, "user", of(parts)), (2, None, None), (3, "assistant", of(odd)), (4, "assistant", of([{"text": long}])), (5, "user", [])], f"conv_id long, role string, parts {chat.PARTS}")
    out = chat.format_turns(df.withColumn("formatted", F.lit("x")), ["conv_id", "formatted"], content="parts").orderBy("conv_id").collect()
    assert out[0].asDict().keys() == {"conv_id", "formatted", "mask_start", "mask_end", "n_errors", "attachments"}
    assert out[0]["formatted"] == formatted and out[0]["attachments"][0]["n_tokens"] == 3 and out[1]["formatted"] == out[4]["formatted"].replace("user", "") == "<|im_start|>\n<|im_end|>\n"
    assert [(a["kind"], a["ref"], a["n_tokens"]) for a in out[2]["attachments"]] == [("unknown", "v", 1), ("unknown", None, 1), ("audio", None, 1), ("audio", None, 1), ("image", None, 1), ("document", None, 512), ("audio", None, 1), ("image", None, 2)]
    assert out[2]["n_errors"] == 7 and [r["n_errors"] for r in out if r["conv_id"] != 3] == [0] * 4
    assert chat.read_turn(out[3]["formatted"]) == ("assistant", long) and out[3]["mask_end"] - out[3]["mask_start"] == len(long) + 200_000


def test_clashing_keys_give_way(spark, docs):
    path = __import__("public_tokenizers").path("piece_bpe_32k.model")
    keys = [c for c in docs.columns if c != "text"]
    for found, own in ((fingerprints.fingerprint_documents(docs, keys), ["fingerprint"]), (quality.score_documents(docs, quality.Machine(), keys), ["score"]), (tokens.count_tokens(docs, path, keys), ["n_bytes", "n_tokens"]), (urls.filter_urls(docs.withColumnRenamed("text", "url").withColumn("host", F.lit("x")), [*keys, "host"]), ["host", "path", "rule", "verdict"])):
        assert found.columns == [k for k in keys if k not in own] + own and found.count() == len(ROWS)
        assert not {"x"} & {r[c] for r in found.select(*own).collect() for c in own}


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, "system", None), (2, 0, "assistant", "<|im_end|>"), (None, 0, None, "x"), (None, 0, None, "x"), (None, 1, None, "y"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    every = chat.digests(chat.format_turns(df, ["conv_id", "turn"])).collect()
    found = {r["conv_id"]: r for r in every}
    assert sum(r["conv_id"] is None for r in every) == 3 and len(every) == 5
    assert found[1]["n_turns"] == 4 and found[1]["turns_sha256"] == hashlib.sha256(b"system\n\nuser\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert (found[1]["loss_chars"], found[1]["loss_sha256"]) == (2, hashlib.sha256(b"bb").hexdigest())
    assert found[2]["loss_sha256"] == hashlib.sha256(b"<|im_end|>").hexdigest() and found[None]["n_turns"] == 1
    assert chat.digests(chat.format_turns(df.limit(0), ["conv_id", "turn"])).count() == 0
    assert {r["conv_id"] for r in queries.op10_chat_formatting(spark, SF).where("conv_id < 0").collect()} == {-1}
