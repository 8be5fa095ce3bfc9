"""Column functions of the engine, for use in any select or filter."""

from stainloom.operators.batch import bare, finite, is_image, label_of
from stainloom.operators.parity import difference
from stainloom.plans.synth import gray

__all__ = ["bare", "difference", "finite", "gray", "is_image", "label_of"]
