"""Email addresses in linear time.

Searching the address pattern directly rescans a run of address characters from each word
boundary in it. Here a text is cut at its ``@`` signs, and each sign is looked at once: the
part before it is the run of local characters that ends there, from its first word boundary
on; the part after it is matched from its beginning. Only where a domain fills all the text
up to the next sign do two signs compete for the same characters; then the first one wins.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factsieve.functions.arrays import empty, let, running_sum
from factsieve.functions.patterns import EMAIL_DOMAIN, EMAIL_LOCAL_END, EMAIL_RUN, java
from factsieve.functions.spans import SPAN, lengths, span_at

# What is known of one sign: no address, an address, or one unless the sign before has one.
_NONE, _SURE, _UNLESS = "N", "M", "C"


def _signs(text: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use(pieces, domains, signs)``; ``signs`` has the local part and the kind of each sign."""

    def of(pieces: Column, domains: Column) -> Column:
        def sign(i: Column) -> Column:
            before = F.get(pieces, i - 1)
            backwards = F.reverse(before)
            run = F.regexp_extract(backwards, java(f"^{EMAIL_RUN}*+"), 0)
            n = F.char_length(run)
            whole = n == F.char_length(before)
            ahead = F.when(whole, F.when(i > 1, "@").otherwise("")).otherwise(
                F.substring(backwards, n + 1, F.lit(1))
            )
            local = F.regexp_extract(F.concat(ahead, F.reverse(run)), java(EMAIL_LOCAL_END), 1)
            taken = F.when(i > 1, F.get(domains, i - 1)).otherwise("")
            kind = (
                F.when((F.get(domains, i) == "") | (local == ""), _NONE)
                .when(whole & (taken != "") & (taken == before), _UNLESS)
                .otherwise(_SURE)
            )
            rest = F.when(whole & (taken != ""), F.substring(before, F.char_length(taken) + 1, n))
            return F.struct(local.alias("local"), rest.alias("rest"), kind.alias("kind"))

        numbers = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: i > 0)
        return let(F.transform(numbers, sign), lambda signs: use(pieces, domains, signs))

    def domain(piece: Column) -> Column:
        return F.regexp_extract(piece, java(f"^{EMAIL_DOMAIN}"), 0)

    return let(
        F.split(text, "@", -1), lambda pieces: let(F.transform(pieces, domain), lambda d: of(pieces, d))
    )


def any_email(text: Column) -> Column:
    """True if the text holds an address."""
    # a sign that depends on the one before it is an address itself, or that one is
    found = _signs(text, lambda pieces, domains, signs: F.exists(signs, lambda s: s["kind"] != _NONE))
    return F.contains(text, F.lit("@")) & found


def email_spans(text: Column) -> Column:
    """All addresses, left to right, with byte and character offsets."""

    def located(pieces: Column, domains: Column, signs: Column) -> Column:
        kinds = F.array_join(F.transform(signs, lambda s: s["kind"]), "")
        # pairs from the left: of two signs the first has the address; whoever is left over has one
        settled = F.translate(
            F.regexp_replace(kinds, f"[{_SURE}{_UNLESS}]{_UNLESS}", _SURE + _NONE), _UNLESS, _SURE
        )
        steps = F.transform(pieces, lambda p: lengths(p) + lengths(F.lit("@")))
        zipped = F.arrays_zip(
            signs.alias("sign"), F.split(settled, "").alias("hit"), running_sum(steps).alias("end")
        )

        def of(all_: Column) -> Column:
            def found(z: Column, i: Column) -> Column:
                rest = z["sign"]["rest"]
                ahead = F.coalesce(F.get(all_, i - 1)["hit"] == _SURE, F.lit(False))
                local = F.when(ahead & rest.isNotNull(), rest).otherwise(z["sign"]["local"])
                domain = F.get(domains, i + 1)
                return F.when(
                    z["hit"] == _SURE,
                    span_at(F.concat(local, F.lit("@"), domain), z["end"] + lengths(domain)),
                )

            return F.filter(F.transform(all_, found), lambda s: s.isNotNull())

        return let(zipped, of)

    return F.when(F.contains(text, F.lit("@")), _signs(text, located)).otherwise(empty(SPAN))


def emails(text: Column) -> Column:
    """All addresses, left to right."""
    return F.transform(email_spans(text), lambda s: s["raw"])
