"""Forward passes of a joint code and description encoder from supplied weights, in numpy, for batches of rows.

Weights are a mapping of arrays. Of each sequence encoder x (name, api, desc): `x.embedding` (words, size), and for
both directions d (forward, backward) `x.d.input` (4 * hidden, size), `x.d.state` (4 * hidden, hidden) and `x.d.bias`
(4 * hidden), with the gates in the order input, forget, cell, output. `tokens.embedding` is that of the bag of tokens.
Linear layers are `name`, `api`, `tokens`, `fuse` and `desc`, each with `.weight` (out, in) and `.bias` (out).
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd

Weights = Mapping[str, np.ndarray]


def matrix(column: pd.Series) -> np.ndarray:
    """Padded sequences of one length as rows."""
    return np.array(column.tolist(), np.int64).reshape(len(column), -1)


def final_states(x: np.ndarray, lengths: np.ndarray, weights: Weights, prefix: str) -> np.ndarray:
    """State of one direction of a recurrent layer after the last of each row's steps; x is (rows, steps, size)."""
    into, across, bias = (np.asarray(weights[f"{prefix}.{k}"]) for k in ("input", "state", "bias"))
    hidden = across.shape[1]
    state, cell = np.zeros((2, len(x), hidden))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    given = x @ into.T + bias
    for step in range(int(lengths.max(initial=0))):
        i, f, g, o = np.split(given[:, step] + state @ across.T, 4, axis=1)
        fresh = sigmoid(f) * cell + sigmoid(i) * np.tanh(g)
        going = (step < lengths)[:, None]
        cell = np.where(going, fresh, cell)
        state = np.where(going, sigmoid(o) * np.tanh(fresh), state)
    return state


def sequence_vector(ids: np.ndarray, lengths: np.ndarray, weights: Weights, name: str) -> np.ndarray:
    """Both directions' last states, side by side; a row without steps has zeros."""
    x = np.asarray(weights[f"{name}.embedding"])[ids]
    at = np.arange(ids.shape[1])
    turned = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)  # each row's own steps in reverse
    back = np.take_along_axis(x, turned[:, :, None], 1)
    return np.concatenate([final_states(x, lengths, weights, f"{name}.forward"), final_states(back, lengths, weights, f"{name}.backward")], 1)


def linear(x: np.ndarray, weights: Weights, name: str) -> np.ndarray:
    return x @ np.asarray(weights[f"{name}.weight"]).T + np.asarray(weights[f"{name}.bias"])


def encode_code(rows: pd.DataFrame, weights: Weights) -> np.ndarray:
    """Vectors of functions from padded name, api and tokens and the lengths of the first two. Tokens are pooled by their greatest values, padding included."""
    parts = [linear(sequence_vector(matrix(rows[c]), rows[f"{c}_len"].to_numpy(), weights, c), weights, c) for c in ("name", "api")]
    parts.append(linear(np.asarray(weights["tokens.embedding"])[matrix(rows["tokens"])].max(1), weights, "tokens"))
    return linear(np.tanh(sum(parts)), weights, "fuse")


def encode_description(rows: pd.DataFrame, weights: Weights) -> np.ndarray:
    """Vectors of descriptions from padded desc and its length."""
    return linear(sequence_vector(matrix(rows["desc"]), rows["desc_len"].to_numpy(), weights, "desc"), weights, "desc")
