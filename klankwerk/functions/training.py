"""Learning-rate schedule, step counts, guidance and sampling mathematics, and hash-based random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from klankwerk.functions.tokens import let
from klankwerk.schemas import EOS

_RANGE = 1 << 52


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on ``seed`` and the keys alone, whatever the layout or the number of retries."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(_RANGE)) + F.lit(0.5)) / F.lit(float(_RANGE))


def cosine_with_warmup(step: Column, rate: float, warmup: int, total: int, cycles: float = 1.0) -> Column:
    """Linear to ``rate`` over ``warmup`` steps, then a cosine of ``cycles`` cycles, never below 0."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    wave = F.lit(0.5) * (1.0 + F.cos(F.lit(2 * math.pi * cycles) * progress))
    return F.when(step < warmup, F.lit(rate) * step / F.lit(float(max(1, warmup)))).otherwise(F.lit(rate) * F.greatest(F.lit(0.0), wave))


def total_steps(samples: Column, batch: int, accumulation: int, epochs: int) -> Column:
    """Optimiser steps: whole batches of ``batch * accumulation`` samples, times the epochs."""
    return F.floor(samples / (batch * accumulation)) * epochs


def guided(conditional: Column, unconditional: Column, scale: float) -> Column:
    """Classifier-free guidance on two arrays of logits."""
    return F.zip_with(conditional, unconditional, lambda c, u: c + F.lit(scale) * (c - u))


def eos_masked(logits: Column, channel: Column, eos: int = EOS) -> Column:
    """Nothing above EOS ever, and EOS only in channel 0; ruled-out logits are null."""
    return F.transform(logits, lambda x, v: F.when((v <= eos) & ((channel == 0) | (v != eos)), x))


def eos_only_if_best(logits: Column, eos: int = EOS) -> Column:
    """EOS ruled out where another logit is greater, everything else ruled out where EOS is greatest."""

    def ruled(y: Column) -> Column:
        best = F.get(y, F.lit(eos)) == F.array_max(y)
        return let(best, lambda b: F.transform(y, lambda x, v: F.when((v == eos) == b, x)))

    return let(logits, ruled)


def softmax(logits: Column) -> Column:
    """Null logits have probability 0."""
    weights = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0))))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return let(weights, lambda w: let(total(w), lambda t: F.transform(w, lambda x: x / t)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax(logits)[target]; logits of null do not count."""
    def entropy(top: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.coalesce(F.exp(x - top), F.lit(0.0)))
        return F.ln(total) + top - F.get(logits, target)

    return let(F.array_max(logits), entropy)


def gumbel(seed: int, *keys: Column) -> Column:
    """Noise that turns an arg-max of logits into a draw from their softmax."""
    return -F.ln(-F.ln(uniform(seed, *keys)))


# ---- element-wise steps of a layer, on one vector each ----


def rms_norm(x: Column, eps: float = 1e-5) -> Column:
    """The vector over the root of its mean square."""
    root = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y) / F.size(v) + F.lit(eps))
    return let(x, lambda v: let(root(v), lambda r: F.transform(v, lambda y: y / r)))


def silu(x: Column) -> Column:
    return F.transform(x, lambda y: y / (1 + F.exp(-y)))


def rotated(x: Column, position: Column, longest: float = 10_000.0) -> Column:
    """Rotary position: halves turned against each other by position over a time scale that rises to ``longest``."""

    def turned(v: Column) -> Column:
        half = (F.size(v) / 2).cast("int")
        angle = lambda i: position / F.pow(F.lit(longest), 2.0 * i / F.size(v))
        a, b = F.slice(v, F.lit(1), half), F.slice(v, half + 1, half)
        pairs = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p, i: F.struct((p["a"] * F.cos(angle(i)) - p["b"] * F.sin(angle(i))).alias("a"), (p["b"] * F.cos(angle(i)) + p["a"] * F.sin(angle(i))).alias("b")))
        return F.concat(F.transform(pairs, lambda p: p["a"]), F.transform(pairs, lambda p: p["b"]))

    return let(x, turned)
