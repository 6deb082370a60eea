"""Predictions for the words of windows, put in their document's places (Arrow arrays; nothing becomes a Python object)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _ints(values: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(values, 0), np.int64)


def _moved(lists: pa.Array, name: str, to: Callable[[pa.Array, np.ndarray], pa.Array]) -> pa.Array:
    """lists of structs with another value of one field: to gets its values and the list of each."""
    sizes, inner = _ints(pc.list_value_length(lists)), lists.flatten()
    value = inner.field(name)
    new = to(value, np.repeat(np.arange(len(lists)), sizes)).cast(value.type)
    fields = [new if f.name == name else inner.field(f.name) for f in inner.type]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(inner.type), mask=inner.is_null()), mask=lists.is_null())


def target_words(windows: pa.Array, words: pa.Array, places: dict[str, pa.Array]) -> tuple[pa.Array, pa.Array, dict[str, pa.Array]]:
    """document, word_idx and fields of the target words, from one row a window: document, an entry for each word, and predicting.PLACES.

    As predicting.in_place(): heads and discourse count words from the window's first, cohesion too and then special tokens.
    """
    n, sizes = _ints(places["n_words"]), _ints(pc.list_value_length(words))
    if (wrong := np.flatnonzero(n != sizes)).size:
        raise ValueError(f"a prediction for a window of {n[wrong[0]]} words has {sizes[wrong[0]]}")
    row = np.repeat(np.arange(len(words)), sizes)
    k = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
    target = k >= (n - _ints(places["n_targets"]))[row]
    row, k = row[target], k[target]
    base, own_n, doc_n = (_ints(places[c])[row] for c in ("first_word", "n_words", "doc_words"))
    found = words.flatten().filter(pa.array(target))
    fields = dict(zip([f.name for f in found.type], found.flatten(), strict=True))
    moved = {
        "heads": ("head", lambda v, of: pc.if_else(pc.less(v, 0), v, pc.add(v, pa.array(base[of])))),
        "cohesion": ("tgt", lambda v, of: pc.add(v, pc.if_else(pc.less(v, pa.array(own_n[of])), pa.array(base[of]), pa.array((doc_n - own_n)[of])))),
        "discourse": ("tgt", lambda v, of: pc.add(v, pa.array(base[of]))),
    }
    own = {f: _moved(values, *moved[f]) if f in moved else values for f, values in fields.items()}
    return windows.take(pa.array(row)), pa.array(base + k, pa.int32()), own
