"""CoNLL-U: reading with validation, and the shared-task scores."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

#: Content-word relations and universal features that count, of the 2018 shared task (fixed values).
CONTENT_DEPRELS = frozenset("nsubj obj iobj csubj ccomp xcomp obl vocative expl dislocated advcl advmod discourse nmod appos nummod acl amod conj fixed flat compound list parataxis orphan goeswith reparandum root dep".split())
FUNCTIONAL_DEPRELS = frozenset("aux cop mark det clf case cc".split())
UNIVERSAL_FEATURES = frozenset("PronType NumType Poss Reflex Foreign Abbr Gender Animacy Number Case Definite Degree VerbForm Mood Tense Aspect Voice Evident Polarity Person Polite".split())


class Word(NamedTuple):
    start: int
    end: int
    sentence: int
    form: str
    lemma: str
    upos: str
    xpos: str
    feats: str
    head: int  # place in the file's words, -1 for the root
    deprel: str
    multi: bool = False


class Treebank(NamedTuple):
    text: str
    tokens: list[tuple[int, int]]
    sentences: list[tuple[int, int]]
    words: list[Word]
    sides: list[tuple[int, int, int, int]]  # multi-word tokens: span and first and last word


class ConllError(ValueError):
    pass


def sentence_errors(rows: Sequence[Sequence[str]]) -> list[str]:
    """What is wrong with one sentence's word rows (10 columns each): ids, heads, roots, cycles."""
    out = [f"{len(r)} columns" for r in rows if len(r) != 10]
    if out:
        return out
    words = [r for r in rows if "-" not in r[0] and "." not in r[0]]
    if [r[0] for r in words] != [str(k + 1) for k in range(len(words))]:
        return ["ids aren't sequential"]
    heads = []
    for r in words:
        try:
            heads.append(int(r[6]))
        except ValueError:
            return [f"head {r[6]!r} isn't a number"]
    if any(h < 0 or h > len(words) for h in heads):
        out.append("a head is out of range")
    if sum(h == 0 for h in heads) != 1:
        out.append("not one root")
    if not out:
        state = [0] * (len(heads) + 1)
        state[0] = 2
        for start in range(1, len(heads) + 1):
            path, at = [], start
            while state[at] == 0:
                state[at] = 1
                path.append(at)
                at = heads[at - 1]
            if state[at] == 1:
                out.append("a cycle")
                break
            for p in path:
                state[p] = 2
    return out


def read(lines: Iterable[str]) -> Treebank:
    """The treebank; raises ConllError if a sentence isn't well-formed."""
    text, tokens, sentences, words, sides = "", [], [], [], []
    rows: list[list[str]] = []

    def close() -> None:
        nonlocal text
        if not rows:
            return
        if wrong := sentence_errors(rows):
            raise ConllError(wrong[0])
        base, begin, covered = len(words), len(text), 0
        for r in rows:
            if "." in r[0]:
                continue
            if "-" in r[0]:
                first, last = map(int, r[0].split("-"))
                form = r[1].replace(" ", "")
                tokens.append((len(text), len(text) + len(form)))
                sides.append((len(text), len(text) + len(form), base + first - 1, base + last - 1))
                text, covered = text + form, last
                continue
            k = int(r[0])
            if k > covered:
                form = r[1].replace(" ", "")
                span = (len(text), len(text) + len(form))
                text += form
                tokens.append(span)
            else:
                span = tokens[-1]
            feats = "" if r[5] == "_" else "|".join(sorted(f for f in r[5].split("|") if f.split("=", 1)[0] in UNIVERSAL_FEATURES))
            words.append(Word(*span, len(sentences), r[1], r[2], r[3], r[4], feats, base + int(r[6]) - 1 if int(r[6]) else -1, r[7].split(":")[0], k <= covered))
        sentences.append((begin, len(text)))
        rows.clear()

    for line in lines:
        line = line.rstrip("\r\n")
        if not line:
            close()
        elif not line.startswith("#"):
            rows.append(line.split("\t"))
    if rows:
        raise ConllError("no empty line at the end")
    return Treebank(text, tokens, sentences, words, sides)


def longest_common(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, the earliest in a and b."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align_words(gold: Treebank, system: Treebank) -> list[tuple[int, int]]:
    """Pairs of words: equal spans, and within stretches of multi-word tokens a longest common subsequence of forms."""
    out = []
    g = s = 0
    gw, sw = gold.words, system.words
    while g < len(gw) and s < len(sw):
        if gw[g].multi or sw[s].multi:
            if gw[g].multi and sw[s].start < gw[g].start and not sw[s].multi:
                s += 1
                continue
            if sw[s].multi and gw[g].start < sw[s].start and not gw[g].multi:
                g += 1
                continue
            limit, g2, s2 = (gw[g] if gw[g].multi else sw[s]).end, g, s
            while (g2 < len(gw) and gw[g2].start < limit) or (s2 < len(sw) and sw[s2].start < limit):
                if g2 < len(gw) and gw[g2].start < limit:
                    limit, g2 = max(limit, gw[g2].end if gw[g2].multi else limit), g2 + 1
                else:
                    limit, s2 = max(limit, sw[s2].end if sw[s2].multi else limit), s2 + 1
            pairs = longest_common([w.form.lower() for w in gw[g:g2]], [w.form.lower() for w in sw[s:s2]])
            out += [(g + a, s + b) for a, b in pairs]
            g, s = g2, s2
        elif (gw[g].start, gw[g].end) == (sw[s].start, sw[s].end):
            out.append((g, s))
            g, s = g + 1, s + 1
        elif gw[g].start <= sw[s].start:
            g += 1
        else:
            s += 1
    return out


def f1(n_gold: int, n_system: int, right: int) -> float:
    return 2 * right / (n_gold + n_system) if n_gold + n_system else 0.0


def score(gold: Treebank, system: Treebank) -> dict[str, float]:
    """F1 of the 13 metrics of the 2018 shared task."""
    return {m: f1(*n) for m, n in counts(gold, system).items()}


def counts(gold: Treebank, system: Treebank) -> dict[str, tuple[int, int, int]]:
    """For each of the 13 metrics of the 2018 shared task: units of gold, of system, and how many are right."""
    if gold.text != system.text:
        raise ConllError("the texts differ")
    pairs = align_words(gold, system)
    to_gold = {s: g for g, s in pairs}
    functional: list[dict[int, list[int]]] = [{}, {}]
    for t, own in zip((gold, system), functional, strict=True):
        for k, w in enumerate(t.words):
            if w.head >= 0 and w.deprel in FUNCTIONAL_DEPRELS:
                own.setdefault(w.head, []).append(k)

    def children(g: int, s: int) -> bool:
        own = [(to_gold.get(k, "unaligned"), system.words[k].deprel, system.words[k].upos, system.words[k].feats) for k in functional[1].get(s, ())]
        return own == [(k, gold.words[k].deprel, gold.words[k].upos, gold.words[k].feats) for k in functional[0].get(g, ())]

    # each pair is looked at once, for all metrics
    n_upos = n_xpos = n_feats = n_tags = n_lemmas = n_uas = n_las = n_clas = n_mlas = n_blex = 0
    for g, s in pairs:
        a, b = gold.words[g], system.words[s]
        upos, xpos, feats = a.upos == b.upos, a.xpos == b.xpos, a.feats == b.feats
        lemma = a.lemma == "_" or a.lemma == b.lemma
        attached = (-1 if b.head < 0 else to_gold.get(b.head)) == a.head  # the gold word that the system word's head is aligned with; -1 for the root
        n_upos += upos
        n_xpos += xpos
        n_feats += feats
        n_tags += upos and xpos and feats
        n_lemmas += lemma
        n_uas += attached
        if attached and a.deprel == b.deprel:
            n_las += 1
            if a.deprel in CONTENT_DEPRELS:
                n_clas += 1
                n_mlas += upos and feats and children(g, s)
                n_blex += lemma
    words = lambda right: (len(gold.words), len(system.words), right)
    n_content = [sum(w.deprel in CONTENT_DEPRELS for w in t.words) for t in (gold, system)]
    content = lambda right: (*n_content, right)
    spans = lambda a, b: (len(a), len(b), len(set(a) & set(b)))
    return {
        "Tokens": spans(gold.tokens, system.tokens), "Sentences": spans(gold.sentences, system.sentences), "Words": words(len(pairs)),
        "UPOS": words(n_upos), "XPOS": words(n_xpos), "UFeats": words(n_feats), "AllTags": words(n_tags), "Lemmas": words(n_lemmas), "UAS": words(n_uas), "LAS": words(n_las),
        "CLAS": content(n_clas), "MLAS": content(n_mlas), "BLEX": content(n_blex),
    }
