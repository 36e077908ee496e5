"""Logarithms where zero is minus infinity, as SQL expressions over columns and arrays.

Spark's ln(0) is NULL, which sums would skip; here it is -Infinity, and sums of
logarithms stay there.
"""

from __future__ import annotations

NEG_INF = "double('-infinity')"


def ln(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ln({x}) WHEN {x} = 0 THEN {NEG_INF} END)"


def lse(array: str) -> str:
    """log(sum(exp(x))) over an array; -Infinity if it is empty or all of it is."""
    m = f"array_max({array})"
    return f"(CASE WHEN size({array}) = 0 OR {m} = {NEG_INF} THEN {NEG_INF} ELSE {m} + ln(aggregate({array}, 0D, (u, x) -> u + exp(x - {m}))) END)"


def add(a: str, b: str) -> str:
    """log(exp(a) + exp(b))."""
    hi, lo = f"greatest({a}, {b})", f"least({a}, {b})"
    return f"(CASE WHEN {hi} = {NEG_INF} THEN {NEG_INF} ELSE {hi} + log1p(exp({lo} - {hi})) END)"


def log_softmax(array: str) -> str:
    return f"transform({array}, z -> z - {lse(array)})"


def log_softmax_binary(logit: str) -> str:
    """[log P(0), log P(1)] of a single logit, exact for large ones."""
    log_sigmoid = lambda z: f"(least({z}, 0D) - log1p(exp(-abs({z}))))"
    return f"array({log_sigmoid(f'(-({logit}))')}, {log_sigmoid(f'({logit})')})"


def temper(log_q: str, temperature: str) -> str:
    """Log probabilities at a temperature, normalised anew."""
    scaled = f"transform({log_q}, l -> l / {temperature})"
    return f"element_at(transform(array({scaled}), s -> transform(s, x -> x - {lse('s')})), 1)"


def arg_max(array: str) -> str:
    """Index from 0 of the first greatest entry."""
    return f"(cast(array_position({array}, array_max({array})) AS int) - 1)"


def not_coherent(log_q_c: str) -> str:
    """log(1 - q(C)) from log q(C), which may exceed zero by rounding."""
    return ln(f"(-expm1(least({log_q_c}, 0D)))")
