"""One step of the trained LSTM as a graph for onnxruntime, which multiplies and squashes small matrices faster than numpy does.

The graph's file format is written here field by field (protocol buffers: a key of number and type, then a number or a length
with bytes). Without onnxruntime the model runs in numpy; both agree to rounding.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format.
FLOAT, INT, OPSET, IR = 1, 2, 13, 8


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(key: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(key << 3) + _number(value)
    value = value.encode() if isinstance(value, str) else value
    return _number(key << 3 | 2) + _number(len(value)) + value


def _node(op: str, inputs: str, outputs: str, axis: int | None = None) -> bytes:
    more = b"" if axis is None else _field(5, _field(1, "axis") + _field(3, axis) + _field(20, INT))
    return _field(1, b"".join(_field(1, x) for x in inputs.split()) + b"".join(_field(2, x) for x in outputs.split()) + _field(4, op) + more)


def _value(key: int, name: str, columns: int) -> bytes:
    shape = _field(1, _field(2, "rows")) + _field(1, _field(1, columns))
    return _field(key, _field(1, name) + _field(2, _field(1, _field(1, FLOAT) + _field(2, shape))))


def graph(u: np.ndarray) -> bytes:
    """Inputs x (what the characters add to the gates), h, c; outputs h2, c2. Gates of u lie in the order in, forget, out, new."""
    n = u.shape[0]
    nodes = [
        _node("MatMul", "h u", "m"), _node("Add", "m x", "z"), _node("Split", "z", "z1 z2 z3 z4", axis=1),
        _node("Sigmoid", "z1", "in"), _node("Sigmoid", "z2", "keep"), _node("Sigmoid", "z3", "out"), _node("Tanh", "z4", "new"),
        _node("Mul", "keep c", "kept"), _node("Mul", "in new", "added"), _node("Add", "kept added", "c2"), _node("Tanh", "c2", "t"), _node("Mul", "out t", "h2"),
    ]
    weights = _field(5, _field(1, n) + _field(1, 4 * n) + _field(2, FLOAT) + _field(8, "u") + _field(9, np.ascontiguousarray(u, "<f4").tobytes()))
    ends = _value(11, "x", 4 * n) + _value(11, "h", n) + _value(11, "c", n) + _value(12, "h2", n) + _value(12, "c2", n)
    return _field(1, IR) + _field(7, b"".join(nodes) + _field(2, "cell") + weights + ends) + _field(8, _field(1, "") + _field(2, OPSET))


def session(u: np.ndarray):
    """A session of one thread, or None without onnxruntime."""
    try:
        import onnxruntime as ort
    except ImportError:
        return None
    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    return ort.InferenceSession(graph(u), options, providers=["CPUExecutionProvider"])
