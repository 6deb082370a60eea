from tsumugi import vocab as v


def test_sizes():
    assert len(v.POS) == 14 and len(v.SUBPOS) == 35
    assert len(v.CONJTYPES) == 33 and len(v.CONJFORMS) == 81 and sum(map(len, v.CONJFORMS_OF.values())) == 639
    assert len(v.VOICED_TO_VOICELESS) == 50 and len(v.PROLONGED_VOWEL) == 48 and len(v.PROLONGED_E) == 12
    assert len(v.HIRAGANA) == len(v.KATAKANA) == 89
    assert len(v.BASE_PHRASE_FEATURES) == 64 and len(set(v.BASE_PHRASE_FEATURES)) == 61
    assert len(v.DISCOURSE_FOLDING) == 20 and len(v.RARE) == 19


def test_samples():
    assert v.SMALL_TO_LARGE["ゎ"] == "わ" and v.PROLONGED_VOWEL["ね"] == "い" and v.PROLONGED_E["ね"] == "え"
    assert v.DISCOURSE_FOLDING["逆接・譲歩(逆方向)"] == "逆接" and v.DISCOURSE_FOLDING["NIL"] == v.NO_DISCOURSE
    assert v.VOICED_TO_VOICELESS["ぱ"] == "は" and v.VOICED_TO_VOICELESS["ヅ"] == "ツ"
    assert v.KATAKANA.startswith("ァアィイ") and "ー" in v.KATAKANA
    assert v.SUBPOS_OF["助詞"]["終助詞"] == 4 and v.SUBPOS_OF["動詞"] == {"*": 0}
    assert v.CONJFORM_ID["サ変動詞"]["文語命令形"] == 20 and v.CONJFORM_ID["ナ形容詞"]["ヤ列タ系連用タリ形"] == 48
    assert [len(v.CONJFORMS_OF[t]) for t in ("*", "母音動詞", "子音動詞カ行", "子音動詞ワ行", "サ変動詞", "判定詞")] == [1, 19, 18, 17, 21, 39]
    assert sorted(t for types, _ in v.PARADIGMS for t in types) == sorted(v.CONJTYPES)
    assert ("接尾辞", "動詞性接尾辞") in v.INFLECTABLE and ("名詞", "普通名詞") not in v.INFLECTABLE
    assert v.ne_tags()[0] == "O" and "B-OPTIONAL" not in v.ne_tags(("OPTIONAL", "PERSON"))
