"""Filtering of given logits and preference arithmetic, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.binding import let


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def softmax(logits: Column | str) -> Column:
    x = F.transform(_c(logits), lambda v: v.cast("double"))
    shifted = let(F.struct(x.alias("x"), F.array_max(x).alias("m")), lambda s: F.transform(s["x"], lambda v: F.exp(v - s["m"])))
    return let(shifted, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total)))


def temperature(logits: Column | str, t: float) -> Column:
    return F.transform(_c(logits), lambda v: v / t)


def repetition_penalty(logits: Column | str, seen: Column | str, penalty: float) -> Column:
    """Positive logits of seen positions (from 0) are divided, negative ones multiplied by the penalty."""
    s = _c(seen)
    return F.transform(_c(logits), lambda v, i: F.when(F.array_contains(s, i), F.when(v > 0, v / penalty).otherwise(v * penalty)).otherwise(v))


def count_penalties(logits: Column | str, history: Column | str, frequency: float, presence: float) -> Column:
    h = _c(history)

    def reduced(v: Column, i: Column) -> Column:
        n = F.size(F.filter(h, lambda x: x == i))
        return v - frequency * n - F.when(n > 0, presence).otherwise(0.0)

    return F.transform(_c(logits), reduced)


def argmax(logits: Column | str) -> Column:
    """The first position (from 0) of the largest logit; null for none."""
    x = _c(logits)
    return F.when(F.size(x) > 0, F.array_position(x, F.array_max(x)) - 1)


def top_k(logits: Column | str, k: int) -> Column:
    """Positions (from 0) of the k largest logits; all that tie with the last of them stay."""
    x = _c(logits)
    kept = let(F.get(F.sort_array(x, False), F.least(F.lit(k), F.size(x)) - 1), lambda least: _where(x, lambda v: v >= least))
    return F.when(F.size(x) > 0, kept).otherwise(F.array().cast("array<int>"))


def min_p(logits: Column | str, share: float) -> Column:
    """Positions whose probability is at least a share of the largest."""
    return let(softmax(logits), lambda p: let(F.array_max(p), lambda top: _where(p, lambda v: v >= share * top)))


def top_p(logits: Column | str, mass: float) -> Column:
    """Positions in falling order of probability (ties by position), through the first that takes the sum beyond ``mass``."""
    p = softmax(logits)
    ranked = F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("n"), i.alias("i"))))
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept"))
    out = F.aggregate(ranked, zero, lambda a, e: F.struct((a["sum"] - e["n"]).alias("sum"), F.when(a["sum"] <= mass, F.array_append(a["kept"], e["i"])).otherwise(a["kept"]).alias("kept")))
    return out["kept"]


def _where(values: Column, test) -> Column:
    marked = F.transform(values, lambda v, i: F.when(test(v), i))
    return F.filter(marked, lambda i: i.isNotNull())


#: Settings for chatting.
CHAT = {"temperature": 0.7, "k": 50, "mass": 0.9, "share": 0.0, "repetition": 1.05, "frequency": 0.3, "presence": 0.3}


def sample_token(
    logits: Column | str, history: Column | str | None = None, draw: Column | float = 0.0, temperature_: float = 1.0, k: int = 0, mass: float = 1.0, share: float = 0.0,
    repetition: float = 1.0, frequency: float = 0.0, presence: float = 0.0,
) -> Column:
    """The next position (from 0): penalties for the history, temperature, least share of the largest probability, the k largest, the top mass, then a draw.

    ``draw`` in [0, 1) picks by the probabilities left, in falling order (ties by position); a temperature of 0 or less takes the largest. Each filter
    works on what the one before left. Null for null or no logits."""
    x = F.transform(_c(logits), lambda v: v.cast("double"))
    if history is not None and repetition != 1.0:
        x = repetition_penalty(x, history, repetition)
    if history is not None and (frequency or presence):
        x = count_penalties(x, history, frequency, presence)
    if temperature_ <= 0:
        return argmax(x).cast("int")

    def chosen(p: Column) -> Column:
        ranked = F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("n"), i.alias("i"))))
        kept = F.filter(ranked, lambda e: -e["n"] >= share * F.array_max(p)) if share > 0 else ranked
        if k > 0:  # all that tie with the k-th stay
            kept = let(kept, lambda r: let(F.get(r, F.least(F.lit(k), F.size(r)) - 1), lambda least: F.filter(r, lambda e: e["n"] <= least["n"])))

        def drawn(r: Column) -> Column:
            total = F.aggregate(r, F.lit(0.0), lambda a, e: a - e["n"])
            if mass < 1:
                zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<n:double,i:int>>").alias("kept"))
                top = let(total, lambda t: F.aggregate(r, zero, lambda a, e: F.struct((a["sum"] - e["n"] / t).alias("sum"), F.when(a["sum"] <= mass, F.array_append(a["kept"], e)).otherwise(a["kept"]).alias("kept")))["kept"])
                return let(top, pick)
            return pick(r)

        def pick(r: Column) -> Column:
            at = F.aggregate(r, F.lit(0.0), lambda a, e: a - e["n"]) * (F.lit(draw) if isinstance(draw, (int, float)) else draw)
            found = let(at, lambda t: F.aggregate(r, F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("i")), lambda a, e: F.struct((a["sum"] - e["n"]).alias("sum"), F.when((a["i"] < 0) & (a["sum"] - e["n"] > t), e["i"]).otherwise(a["i"]).alias("i")))["i"])
            return F.when(found >= 0, found).otherwise(F.element_at(r, -1)["i"])

        return let(kept, drawn)

    return F.when(F.size(x) > 0, let(softmax(F.transform(x, lambda v: v / temperature_)), chosen))


def dpo_loss(policy_good: Column, policy_bad: Column, reference_good: Column, reference_bad: Column, beta: float = 0.1) -> Column:
    """-log sigmoid(beta * difference of the log-ratios), in a form that does not overflow."""
    z = beta * ((policy_good - policy_bad) - (reference_good - reference_bad))
    return F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def clipped_ratio_loss(log_new: Column, log_old: Column, advantage: Column, clip: float = 0.2) -> Column:
    ratio = F.exp(log_new - log_old)
    return -F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip)) * advantage)


def rms_norm(values: Column | str, eps: float = 1e-6) -> Column:
    x = F.transform(_c(values), lambda v: v.cast("double"))
    return let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x), lambda mean: F.transform(x, lambda v: v / F.sqrt(mean + eps)))


def layer_norm(values: Column | str, eps: float = 1e-5) -> Column:
    x = F.transform(_c(values), lambda v: v.cast("double"))

    def centred(mean: Column) -> Column:
        return let(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(x), lambda var: F.transform(x, lambda v: (v - mean) / F.sqrt(var + eps)))

    return let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x), centred)
