"""Course dictionary lookups as literal maps: the dictionary is a handful of fixed rows."""
from itertools import chain

from pyspark.sql import Column, functions as F

from .text import squeeze, strip
from .vocabulary import COURSE_LADDER, COURSES

CODES = [c[0] for c in COURSES]
NON_COURSES = [c[0] for c in COURSES if c[3]]


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def clean_code(c: Column) -> Column:
    return F.upper(strip(c))


def course_name(code: Column) -> Column:
    return F.coalesce(F.element_at(literal_map({c[0]: c[1] for c in COURSES}), code), code)


def known_code(code: Column) -> Column:
    """The code itself when the dictionary has it, else null."""
    return F.when(code.isin(CODES), code)


def code_by_header(header: Column) -> Column:
    aliases = {a: code for code, _, names, _ in COURSES for a in names}
    return F.element_at(literal_map(aliases), F.lower(squeeze(header)))


def is_non_course(code: Column) -> Column:
    return code.isin(NON_COURSES)


def counts_as_seat(kind: Column) -> Column:
    return F.coalesce(kind == "enrolled", F.lit(False))


def next_courses(code: Column) -> Column:
    """Array of the next codes on the ladder (null when the ladder ends)."""
    ladder = F.create_map(*[
        x for k, nxt in COURSE_LADDER.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in nxt]))])
    return F.element_at(ladder, clean_code(code))
