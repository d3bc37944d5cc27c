"""Places of values in a long list, inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def places(values: pa.Array, listed: pa.Array) -> pa.Array:
    """The place in ``listed`` of each value; null where it has none.

    Only the distinct values of a batch are hashed, never the list, and no value becomes a Python object."""
    coded = values.dictionary_encode()
    found = pc.index_in(listed, value_set=coded.dictionary.cast(listed.type))
    at = np.full(len(coded.dictionary), -1, np.int32)
    at[found.drop_null().to_numpy()] = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    return pa.array(at, mask=at < 0).take(coded.indices)
