from . import geometry, text, vectors  # noqa: F401
