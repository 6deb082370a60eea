"""Column types of parsed documents. DataFrames have no order, so every level carries its places."""

from __future__ import annotations

FEATURES = "array<struct<key:string,value:string>>"
SEMANTICS = "struct<nil:boolean,items:array<struct<key:string,value:string>>>"
_WORD = (
    "surf:string,reading:string,lemma:string,pos:string,pos_id:int,subpos:string,subpos_id:int,conjtype:string,conjtype_id:int,"
    f"conjform:string,conjform_id:int,semantics:{SEMANTICS},features:{FEATURES}"
)
MORPHEME = f"struct<{_WORD},homographs:array<struct<{_WORD}>>,bp_idx:int>"
REL = "struct<type:string,target:string,sid:string,bp_idx:int,mode:string>"
BASE_PHRASE = f"struct<parent_idx:int,dep_type:string,features:{FEATURES},n_morphemes:int,rels:array<{REL}>,phrase_idx:int>"
PHRASE = f"struct<parent_idx:int,dep_type:string,features:{FEATURES},n_morphemes:int,n_base_phrases:int>"
SENTENCE = f"struct<sid:string,comment:string,morphemes:array<{MORPHEME}>,base_phrases:array<{BASE_PHRASE}>,phrases:array<{PHRASE}>>"
