"""The line formats of annotated text: morpheme lines, and the same with phrases, features and relations; both ways.

A parsed sentence is a dict of the columns of tsumugi.schema: sid, comment, morphemes, base_phrases, phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

FIELDS = ("surf", "reading", "lemma", "pos", "pos_id", "subpos", "subpos_id", "conjtype", "conjtype_id", "conjform", "conjform_id")
FEATURE = re.compile(r'<((?:"[^"]*"|[^<>"])*)>')
REL = re.compile(r'<rel((?:\s+\w+="[^"]*")*)\s*/>')
ATTRIBUTE = re.compile(r'(\w+)="([^"]*)"')
SID = re.compile(r"^# S-ID:\s*(\S+)\s?(.*)$")


def parse_semantics(text: str) -> dict:
    """Quoted semantics as items (key, values); NIL and nothing at all are told apart."""
    text = text.strip()
    items = []
    if text.startswith('"') and text.endswith('"') and len(text) > 1:
        for word in text[1:-1].split(" "):
            key, colon, value = word.partition(":")
            items.append({"key": key, "value": value if colon else None})
    return {"nil": text == "NIL", "items": [x for x in items if x["key"]]}


def emit_semantics(semantics: dict) -> str:
    if len(semantics["items"]):
        return '"' + " ".join(x["key"] + (f":{x['value']}" if x["value"] is not None else "") for x in semantics["items"]) + '"'
    return "NIL" if semantics["nil"] else ""


def parse_features(text: str) -> list[dict]:
    """<key:value> and <key> in order, as key and value (null for a mere flag)."""
    out = []
    for found in FEATURE.findall(text):
        key, colon, value = found.partition(":")
        out.append({"key": key, "value": value if colon else None})
    return out


def emit_features(features: Iterable[dict]) -> str:
    return "".join(f"<{f['key']}" + (f":{f['value']}" if f["value"] is not None else "") + ">" for f in features)


def parse_morpheme(line: str) -> dict:
    """One morpheme line; a written form may itself be a space or a quote. Raises ValueError if fields are missing."""
    if line.startswith("  "):  # a space as a morpheme: its first three fields are spaces
        parts = [" ", " ", " ", *line[6:].split(" ", 8)]
    else:
        parts = line.split(" ", 11)
    if len(parts) < 11:
        raise ValueError(f"not a morpheme line: {line!r}")
    out: dict = dict(zip(FIELDS, parts[:11], strict=True))
    for name in FIELDS:
        if name.endswith("_id"):
            out[name] = int(out[name])
    rest = parts[11] if len(parts) > 11 else ""
    quoted = re.match(r'("[^"]*"|NIL)?\s*(.*)$', rest, re.DOTALL)
    out["semantics"] = parse_semantics(quoted[1] or "")
    out["features"] = parse_features(quoted[2])
    return out


def emit_morpheme(m: dict, prefix: str = "") -> str:
    tail = [x for x in (emit_semantics(m["semantics"]), emit_features(m["features"])) if x]
    return prefix + " ".join([*(str(m[f]) for f in FIELDS), *tail])


def head_of(mark: str) -> tuple[int, str]:
    found = re.fullmatch(r"(-?\d+)([DPAI])", mark)
    if not found:
        raise ValueError(f"not a head: {mark!r}")
    return int(found[1]), found[2]


def parse_rels(text: str) -> tuple[list[dict], str]:
    """Relations, and the text without them."""
    rels = []
    for found in REL.findall(text):
        a = dict(ATTRIBUTE.findall(found))
        rels.append({"type": a.get("type"), "target": a.get("target"), "sid": a.get("sid"), "bp_idx": int(a["id"]) if a.get("id") else None, "mode": a.get("mode")})
    return rels, REL.sub("", text)


def emit_rel(rel: dict) -> str:
    pairs = [("type", rel["type"]), ("mode", rel["mode"]), ("target", rel["target"]), ("sid", rel["sid"]), ("id", rel["bp_idx"])]
    return "<rel" + "".join(f' {k}="{v}"' for k, v in pairs if v is not None) + "/>"


def parse_sentence(lines: list[str]) -> dict:
    """A sentence's lines without EOS. Homographs (@) go to the morpheme before; phrases are optional."""
    out: dict = {"sid": None, "comment": None, "morphemes": [], "base_phrases": [], "phrases": []}
    for line in lines:
        if line.startswith("#") and not out["morphemes"] and not re.match(r"^# \S+ ", line) or line.startswith("# S-ID:") or line.startswith("# D-ID:"):
            sid = SID.match(line)
            if sid:
                out["sid"], out["comment"] = sid[1], sid[2] or None
        elif line.startswith("@ ") and not line.startswith("@ @ "):
            if not out["morphemes"]:
                raise ValueError("a homograph without a morpheme")
            out["morphemes"][-1]["homographs"].append(parse_morpheme(line[2:]))
        elif re.match(r"^[*+] -?\d+[DPAI]( |$)", line):
            head, kind = head_of(line.split(" ")[1])
            rels, rest = parse_rels(line)
            unit = {"parent_idx": head, "dep_type": kind, "features": parse_features(rest), "n_morphemes": 0}
            if line[0] == "*":
                out["phrases"].append({**unit, "n_base_phrases": 0})
            else:
                out["base_phrases"].append({**unit, "rels": rels, "phrase_idx": len(out["phrases"]) - 1})
                if out["phrases"]:
                    out["phrases"][-1]["n_base_phrases"] += 1
        else:
            m = parse_morpheme(line) | {"homographs": [], "bp_idx": len(out["base_phrases"]) - 1 if out["base_phrases"] else None}
            out["morphemes"].append(m)
            for unit in (out["base_phrases"], out["phrases"]):
                if unit:
                    unit[-1]["n_morphemes"] += 1
    return out


def emit_sentence(s: dict) -> str:
    """The lines of a sentence, EOS included; the inverse of parse_sentence for what it keeps."""
    lines = []
    if s["sid"] is not None:
        lines.append(f"# S-ID:{s['sid']}" + (f" {s['comment']}" if s["comment"] else ""))
    at_bp = at_phrase = -1
    for m in s["morphemes"]:
        if m["bp_idx"] is not None and m["bp_idx"] != at_bp:
            at_bp = m["bp_idx"]
            bp = s["base_phrases"][at_bp]
            if bp["phrase_idx"] != at_phrase and bp["phrase_idx"] >= 0:
                at_phrase = bp["phrase_idx"]
                lines.append(unit_line("*", s["phrases"][at_phrase], ""))
            lines.append(unit_line("+", bp, "".join(map(emit_rel, bp["rels"]))))
        lines.append(emit_morpheme(m))
        lines += [emit_morpheme(h, "@ ") for h in m["homographs"]]
    return "\n".join([*lines, "EOS"]) + "\n"


def unit_line(mark: str, unit: dict, rels: str) -> str:
    tail = rels + emit_features(unit["features"])
    return f"{mark} {unit['parent_idx']}{unit['dep_type']}" + (f" {tail}" if tail else "")


def sentences_of(text: str | Iterable[str]) -> Iterator[list[str]]:
    """The lines of each sentence of a document (a text, or its lines): up to each EOS; lines after the last EOS form one too, if any."""
    lines: list[str] = []
    for line in text.split("\n") if isinstance(text, str) else (x.removesuffix("\n") for x in text):
        if line.strip("\r") == "EOS":
            yield lines
            lines = []
        elif line:
            lines.append(line)
    if lines:
        yield lines


def parse_document(text: str) -> list[dict]:
    return [parse_sentence(lines) for lines in sentences_of(text)]
