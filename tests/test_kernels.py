import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tsumugi.kernels import align, conll, crf, edits, forced, formats, norm, norm_batch, spans, trees
from tsumugi.vocab import CANON, DELIMITER, LEMMA, NO_CANON, READING, SURF


@pytest.mark.parametrize(
    ("surf", "ops", "normal"),
    [
        ("買ぅ", "KS", "買う"), ("ね〜〜", "KED", "ねえ"), ("ガニ", "VK", "カニ"), ("うまそー", "KKKP", "うまそう"), ("きれーい", "KKDK", "きれい"), ("きれー", "KKP", "きれい"), ("あっ", "KD", "あ"),
        ("でーす", "KDK", "です"), ("もーれつ", "KPKK", "もうれつ"), ("関ヶ原", "KSK", "関ケ原"), ("こんばんわ", "KKKKK", "こんばんわ"), ("びみょーー", "KKKPD", "びみょう"), ("ばあ", "VK", "はあ"),
    ],
)
def test_norm_ops_both_ways(surf, ops, normal):
    assert norm.infer_ops(surf, normal) == list(ops)
    assert norm.apply_ops(surf, list(ops)) == normal


def test_norm_edges():
    for surf, normal in (("あ", ""), ("あ", "ああ")):
        with pytest.raises(ValueError, match="no operations"):
            norm.infer_ops(surf, normal)
    assert norm.infer_ops("なあ", "さあ") == ["_", "_"]
    for surf, ops in (("あか", "KV"), ("かー", "SK"), ("あい", "KD"), ("ん〜", "KP")):
        with pytest.raises(ValueError, match="in"):
            norm.apply_ops(surf, list(ops))
    assert norm.apply_ops("か", ["S"], strict=False) == "か" and norm.apply_ops("ー", ["P"], strict=False) == "ー"
    with pytest.raises(NotImplementedError):
        norm.apply_ops("か", ["X"], strict=False)


@given(st.text("あいうえおかきがぎぁぃっー〜", min_size=1, max_size=6), st.integers(0, 10**6))
def test_inferred_ops_lead_to_the_normal_form(surf, seed):
    rng = random.Random(seed)
    ops = [rng.choice("KDVSPE") for _ in surf]
    normal = norm.apply_ops(surf, ops, strict=False)
    if 0 < len(normal) <= len(surf):
        found = norm.infer_ops(surf, normal)
        if "_" not in found:
            assert norm.apply_ops(surf, found) == normal


@pytest.mark.parametrize(("surf", "expected"), [("なあ", "なぁ"), ("もう", "もぅ"), ("関ケ原", "関ヶ原"), ("びみょうだ", "びみょーだ"), ("もどかしいな", "もどかしーな"), ("すげえな", "すげーな"), ("犬", "犬")])
def test_denormalize(surf, expected):
    assert norm.denormalize(surf) == expected


def test_random_variants_are_seeded():
    a = [norm.denormalize_randomly("そうだ", random.Random(k)) for k in range(300)]
    assert a == [norm.denormalize_randomly("そうだ", random.Random(k)) for k in range(300)] and len(set(a)) > 2
    out = norm.denormalize_sentence([("本", "本"), ("です", "です"), ("ガニ", "カニ")], random.Random(1), p=1.0, vary=lambda s, _: s + "ー")
    assert out == ["本", "ですー", "ガニ"] or out == ["本ー", "ですー", "ガニ"]


def test_windows_golden():
    lengths = [20, 40, 30, 50, 20, 50]
    assert spans.split_spans(lengths, 100, 1) == [(0, 3), (2, 4), (2, 5), (4, 6)]
    assert spans.split_spans(lengths, 100, -1) == [(0, 3), (3, 5), (5, 6)]


@settings(max_examples=300)
@given(st.lists(st.integers(1, 10).map(lambda x: 10 * x), min_size=1, max_size=20), st.integers(1, 50).map(lambda x: 10 * x), st.sampled_from([-1, *range(1, 11)]))
def test_windows_properties(lengths, most, stride):
    found = spans.split_spans(lengths, most, stride)
    assert {i for a, b in found for i in range(a, b)} == set(range(len(lengths)))
    ends = [b for _, b in found]
    assert ends == sorted(set(ends)) and ends[-1] == len(lengths)
    for k, (a, b) in enumerate(found):
        size = sum(lengths[a:b])
        before = ends[k - 1] if k else 0
        assert size <= most or b - before == 1
        if stride == -1:
            assert a == before and (size > most or b == len(lengths) or size + lengths[b] > most)
        elif size <= most and a > (found[k - 1][0] if k else 0):
            assert sum(lengths[a - 1 : b]) > most or b - before != stride or a > before - 1


def test_edit_tags():
    parts = edits.decompose("待つの木が枯れる", "松の木が枯れる", [("待つ", "松")])
    keep, insert = edits.tags_of(parts, 9)
    assert keep == ["R:松", "D", *"KKKKKKK"] and insert == ["_"] * 9
    parts = edits.decompose("紹介ことなかった", "紹介することがなかった", [("", "する"), ("", "が")])
    assert edits.tags_of(parts, 9)[1] == ["_", "_", "I:する", "_", "I:が", "_", "_", "_", "_"]
    assert edits.decompose("あいう", "かいえ", [("あ", "か")]) is None
    assert edits.diff_counts("abc", "abd", "xbd") == (1, 0, 1)


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_opcodes_rebuild_the_text(a, b):
    out, cost, at = "", 0, 0
    for op in edits.opcodes(a, b):
        assert op.a1 == at
        at = op.a2
        out += a[op.a1 : op.a2] if op.kind == "equal" else "" if op.kind == "delete" else b[op.b1 : op.b2]
        cost += 0 if op.kind == "equal" else max(op.a2 - op.a1, op.b2 - op.b1)
        assert op.kind != "replace" or op.a2 - op.a1 == op.b2 - op.b1
    assert out == b and cost == sum((Counter(edits.char_diffs(a, b))).values())


@settings(max_examples=200)
@given(st.integers(1, 8), st.randoms(use_true_random=False))
def test_trees_are_trees(n, rng):
    ranked = [[(rng.randrange(-1, n), "D") for _ in range(4)] for _ in range(n)]
    ranked = [[(h, k) for h, k in own if h != i] for i, own in enumerate(ranked)]
    try:
        tree = trees.build_tree(ranked)
    except ValueError:
        return
    heads = dict(enumerate(a.head for a in tree))
    assert not trees.has_cycle(heads) and sum(h == -1 for h in heads.values()) <= 1
    for i, own in enumerate(ranked):
        assert heads[i] in {h for h, _ in own} or tree[i].kind == "D"


def test_tree_fallbacks():
    assert [a.head for a in trees.build_tree([[(1, "P")], [(0, "D")]])] == [1, -1]
    assert trees.has_cycle({0: 1, 1: 0}) and not trees.has_cycle({0: 1, 1: -1})
    assert trees.phrase_heads([trees.Arc(1, "D"), trees.Arc(2, "P"), trees.Arc(-1, "D")], [0, 0, 1]) == {0: trees.Arc(1, "P"), 1: trees.Arc(-1, "D")}


def test_chain_against_brute_force():
    rng = np.random.default_rng(0)
    tags = ("O", "B-X", "I-X", "B-Y", "I-Y")
    chain = crf.Chain(tags, rng.normal(size=5), rng.normal(size=(5, 5)), rng.normal(size=5))
    for _ in range(20):
        e, mask = rng.normal(size=(4, 5)) * 2, np.array([rng.random() < 0.8 for _ in range(4)])
        at = np.flatnonzero(mask)
        found = chain.decode(e, mask)
        assert len(found) == 4
        if len(at) != 4:
            continue

        def score(path, e=e):
            return chain.start[path[0]] + sum(e[k, t] for k, t in enumerate(path)) + sum(chain.step[a, b] for a, b in zip(path, path[1:], strict=False)) + chain.end[path[-1]]

        paths = list(np.ndindex(5, 5, 5, 5))
        scores = np.array([score(p) for p in paths])
        assert tuple(found) == paths[int(scores.argmax())]
        assert np.isclose(chain.log_likelihood(e, list(found), mask), scores.max() - np.log(np.exp(scores - scores.max()).sum()) - scores.max())
        for a, b in zip(["O", *(tags[t] for t in found)], [tags[t] for t in found], strict=False):
            assert not b.startswith("I-") or a[2:] == b[2:]
    assert chain.decode(np.zeros((3, 5)), np.zeros(3, bool)) == [0, 0, 0]
    assert crf.reduce_losses([2.0, 4.0], [2, 4], "mean") == 3.0


KNP = """# S-ID:test-0-0 comment
* 1D
+ 1D <NE:PERSON:太郎><体言>
太郎 たろう 太郎 名詞 6 人名 5 * 0 * 0 "代表表記:太郎/たろう 人名" <基本句-主辞>
は は は 助詞 9 副助詞 2 * 0 * 0 NIL
* -1D
+ -1D <rel type="ガ" target="太郎" sid="test-0-0" id="0"/><rel type="ヲ" target="著者"/><用言:動>
よる よる よる 動詞 2 * 0 子音動詞ラ行 10 基本形 2 "代表表記:因る/よる"
@ よる よる よる 動詞 2 * 0 子音動詞ラ行 10 基本形 2 "代表表記:寄る/よる 自他動詞:他:寄せる/よせる"
EOS
"""


def test_formats_round_trip():
    (s,) = formats.parse_document(KNP)
    assert s["sid"] == "test-0-0" and s["comment"] == "comment" and len(s["morphemes"]) == 3
    assert s["base_phrases"][1]["rels"][1] == {"type": "ヲ", "target": "著者", "sid": None, "bp_idx": None, "mode": None}
    assert s["morphemes"][2]["homographs"][0]["semantics"]["items"][1] == {"key": "自他動詞", "value": "他:寄せる/よせる"}
    assert formats.emit_sentence(s) == KNP
    with pytest.raises(ValueError, match="morpheme"):
        formats.parse_document("a b\nEOS\n")


def test_reading_alignment():
    kanji = {"計": ["けい", "はか"], "算": ["さん"], "機": ["き"], "学": ["がく"], "校": ["こう"]}
    assert align.align_reading(["計算", "機"], "けいさんき", kanji) == ["けいさん", "き"]
    assert align.align_reading(["", "学", "校"], "がっこう", kanji) == ["", "がっ", "こう"]
    assert align.align_reading(["食べ", "る"], "たべる", {}) == ["たべ", "る"]
    assert align.expand_readings(["はか.らう", "-さん", "さん"]) == ["はか", "はから", "さん"]


def test_segment_alignment_and_differences():
    assert align.align_segmentations(["ab", "c", "de"], ["a", "bc", "de"]) == [(0, 2, 0, 2), (2, 3, 2, 3)]
    assert align.align_segmentations(["ab"], ["ac"]) is None
    row = lambda s, r: (s, r, s, s)
    counts = align.morphology_counts([row("a", "x"), row("bc", "y")], [row("a", "x"), row("b", "y"), row("c", "y")])
    assert counts["surf"] == (1, 1, 2)
    assert align.morphology_counts([row("a", "x")], [row("a", "z")])["reading"] == (0, 1, 1)


def test_conll():
    line = lambda i, w, h, rel="nsubj": f"{i}\t{w}\t{w}\t_\t_\t_\t{h}\t{rel}\t_\t_"
    gold = [line(1, "ab", 2), line(2, "c", 0, "root"), ""]
    same = conll.score(conll.read(gold), conll.read(gold))
    assert len(same) == 13 and all(v == 1 for v in same.values())
    other = [line(1, "a", 3), line(2, "b", 3), line(3, "c", 0, "root"), ""]
    scores = conll.score(conll.read(gold), conll.read(other))
    assert scores["Words"] == pytest.approx(2 * 1 / 5) and scores["UAS"] == pytest.approx(2 / 5)
    assert conll.sentence_errors([line(1, "a", 2).split("\t"), line(2, "b", 1).split("\t")]) == ["not one root"]
    assert conll.sentence_errors([line(1, "a", 0).split("\t"), line(2, "b", 3).split("\t"), line(3, "b", 2).split("\t")]) == ["a cycle"]
    multi = ["1-2\tabc\t_\t_\t_\t_\t_\t_\t_\t_", line(1, "ab", 2), line(2, "c", 0, "root"), ""]
    assert conll.score(conll.read(multi), conll.read(gold))["Words"] == 1.0
    with pytest.raises(conll.ConllError):
        conll.read([line(1, "a", 0)])


def test_forced_decoding():
    own = ["<s>", "<pad>", "</s>", SURF, READING, LEMMA, CANON, NO_CANON, DELIMITER, "▁", "▁か", "か", "かみ", "み", "神", "カ"]
    vocab = {t: k for k, t in enumerate(own)}
    decode = lambda ids: "".join(own[i] for i in ids[1:]).replace("▁", " ")
    f = forced.Forced(["かみ"], vocab, decode)
    ids = [vocab["<s>"]]
    assert f.allowed(ids) == {vocab[SURF]}
    ids.append(vocab[SURF])
    assert f.allowed(ids) == {vocab["▁か"], vocab["か"], vocab["かみ"]}
    ids.append(vocab["かみ"])
    assert f.allowed(ids) == {vocab[READING]}
    ids.append(vocab[READING])
    assert vocab["神"] not in f.allowed(ids) and vocab["カ"] not in f.allowed(ids) and vocab[LEMMA] not in f.allowed(ids)
    ids += [vocab["かみ"]]
    assert vocab[LEMMA] in f.allowed(ids)
    ids += [vocab[LEMMA]]
    assert vocab[CANON] not in f.allowed(ids) and vocab["神"] in f.allowed(ids)
    ids += [vocab["神"], vocab[CANON]]
    assert vocab[NO_CANON] in f.allowed(ids) and vocab["</s>"] not in f.allowed(ids)
    ids += [vocab["神"]]
    assert vocab["</s>"] in f.allowed(ids, best=vocab["</s>"]) and f.allowed(ids) == {vocab["</s>"]}


@pytest.mark.parametrize("seed, cells", [(1, 1 << 22), (2, 300)])
def test_operations_of_many_pairs(monkeypatch, seed, cells):
    """Inferred together, pairs get the operations that each gets alone, whatever the size of a table."""
    monkeypatch.setattr(norm_batch, "CELLS", cells)
    rng = random.Random(seed)
    letters = "かがさざなねのゃやーっつぁあいうえおぉ〜とどヴは犬x𠮷"
    pairs = [("", ""), ("あ", ""), ("あ", "ああ"), ("なあ", "さあ")]
    for _ in range(2_000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
        n = "".join(rng.choice([c, norm.SMALL_TO_LARGE.get(c, c), rng.choice(letters) if rng.random() < 0.2 else c, "" if norm.removable(c) else c, "あ" if c == "ー" else c, "え" if c == "ー" else c, norm.VOICED_TO_VOICELESS.get(c, c)]) for c in s)
        pairs.append((s, n))
    plain = []
    for s, n in pairs:
        try:
            plain.append(norm.infer_ops(s, n))
        except ValueError:
            plain.append(None)
    assert norm_batch.infer_ops_of(pairs) == plain
    assert {o for x in plain if x for o in x} == set("KDVSPE_") and norm_batch.infer_ops_of([]) == []
