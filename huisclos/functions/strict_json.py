"""JSON texts as Variants, whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import let


def whole_json(raw: Column) -> Column:
    """The Variant of a text that is one JSON value and nothing else; null otherwise.

    Parsing stops after the first value and passes over what follows it. So the text is read as a list's first item, before
    an item with the text's own hash: no text can end the list earlier and still have its hash there.
    """

    def read(text: Column, end: Column) -> Column:
        get = F.try_variant_get
        alone = lambda v: (get(v, "$[1]", "string") == end) & get(v, "$[2]", "variant").isNull()
        listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), end, F.lit('"]')))
        return let(listed, lambda v: F.when(alone(v), get(v, "$[0]", "variant")))

    return let(raw, lambda text: let(F.sha2(text, 256), lambda end: read(text, end)))
