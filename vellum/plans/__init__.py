"""Named queries: importing the package registers all of them in ``catalogue``."""

from vellum.plans import catalogue, extended, dossiers, forms  # noqa: F401, I001  (in this order)
