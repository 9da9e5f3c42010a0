"""Losses of a row as column expressions; reduce them with F.avg or F.sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .activations import softmax
from .arrays import total


def squared(pred: Column, target: Column) -> Column:
    return F.pow(pred - target, 2)


def absolute(pred: Column, target: Column) -> Column:
    return F.abs(pred - target)


def huber(pred: Column, target: Column, delta: float = 1.0) -> Column:
    d = F.abs(pred - target)
    return F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta))


def binary_cross_entropy(pred: Column, target: Column) -> Column:
    return -(target * F.ln(pred + 1e-15) + (1 - target) * F.ln(1 - pred + 1e-15))


def cross_entropy(logits: Column, label: Column) -> Column:
    """For an array of logits and a class number from 0."""
    most = F.array_max(logits)
    return most + F.ln(total(F.transform(logits, lambda v: F.exp(v - most)))) - F.element_at(logits, label.cast("int") + 1)


def distillation(student: Column, teacher: Column, label: Column, temperature: float = 4.0, alpha: float = 0.5) -> Column:
    """alpha * T^2 * KL(teacher || student) at temperature T, and the rest cross entropy of the student."""
    soft = softmax(F.transform(teacher, lambda v: v / temperature))
    own = softmax(F.transform(student, lambda v: v / temperature))
    kl = total(F.zip_with(soft, own, lambda p, q: p * (F.ln(p + 1e-15) - F.ln(q + 1e-15))))
    return alpha * temperature * temperature * kl + (1 - alpha) * cross_entropy(student, label)
