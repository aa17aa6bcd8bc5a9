"""Distributed union-find: that of the library, with lineage cut as the rest of this subpackage cuts it."""

from __future__ import annotations

from functools import partial

from evidora.llm.common import cut
from evidora.operators import links

components = partial(links.components, cut=cut)
