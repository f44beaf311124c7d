"""The registered queries; importing this package registers them."""

from qirtas.plans import corpus, making, pairs, supervised, vectors  # noqa: F401
