"""Small helpers to put DuckDB statements together from named CTEs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from .clinical import CTES

FIXTURES = {name: CTES[name] for name in ("person", "op", "cond", "vis", "meas", "concept", "ancestor", "sites")}


def listed(codeset: int, *ids: int) -> str:
    text = ", ".join(map(str, ids))
    return f"SELECT {codeset} AS codeset_id, concept_id FROM concept WHERE concept_id IN ({text})"


def below(codeset: int, *ids: int) -> str:
    text = ", ".join(map(str, ids))
    return (
        f"SELECT {codeset} AS codeset_id, c.concept_id FROM concept c"
        f" JOIN ancestor a ON c.concept_id = a.descendant_id"
        f" WHERE a.ancestor_id IN ({text}) AND c.invalid_reason IS NULL"
    )


def expanded(codeset: int, *ids: int) -> str:
    """Listed concepts and their valid descendants."""
    return f"{listed(codeset, *ids)} UNION {below(codeset, *ids)}"


BRANDS_A = (1000001, 1000002, 1000003, 1000004, 1000005)
BRANDS_B = (1000006, 1000007, 1000008, 1000009, 1000010)

CODES = {
    "codes": " UNION ".join(
        [
            *[listed(n, n) for n in (1, 2, 3, 4, 5)],
            expanded(11, *BRANDS_A),
            expanded(12, *BRANDS_B),
            expanded(13, *BRANDS_A, *BRANDS_B),
            listed(21, 9201, 262),
        ]
    )
}


def coded(table: str, codeset: int, where: str = "TRUE") -> str:
    """Events of one clinical table in a code set."""
    return (
        f"(SELECT person_id, id, s, e, visit_id FROM {_with_visit(table)}"
        f" WHERE concept_id IN (SELECT concept_id FROM codes WHERE codeset_id = {codeset})"
        f" AND {where})"
    )


def _with_visit(table: str) -> str:
    return "(SELECT *, id AS visit_id FROM vis)" if table == "vis" else table


def statement(ctes: Mapping[str, str], select: str, materialized: Sequence[str] = ()) -> str:
    parts = [
        f"{name} AS {'MATERIALIZED ' if name in materialized else ''}({body})"
        for name, body in ctes.items()
    ]
    return "WITH " + ",\n".join(parts) + "\n" + select


def eras(source: str, keys: str, strict: bool = True, pad: int = 0) -> str:
    """Merged intervals of ``source`` (keys, s, e), by self joins.

    An interval opens an era if no earlier one (by start, then end) reaches into it; every
    interval belongs to the last opening at or before it.
    """
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in names)
    reaches = "b.e > a.s" if strict else f"b.e + {pad} >= a.s"
    d = f"(SELECT DISTINCT {keys}, s, e FROM {source})"
    opening = (
        f"(SELECT a.* FROM {d} a WHERE NOT EXISTS (SELECT 1 FROM {d} b WHERE {same}"
        f" AND (b.s < a.s OR (b.s = a.s AND b.e < a.e)) AND {reaches}))"
    )
    own = ", ".join(f"a.{k}" for k in names)
    return (
        f"SELECT {keys}, MIN(s) AS s, MAX(e) AS e FROM ("
        f"SELECT {own}, a.s, a.e, MAX({{'s': b.s, 'e': b.e}}) AS opened FROM {d} a JOIN {opening} b"
        f" ON {same} AND (b.s < a.s OR (b.s = a.s AND b.e <= a.e))"
        f" GROUP BY {own}, a.s, a.e) GROUP BY {keys}, opened"
    )


# One row per age and sex subgroup, from the bands and the two sexes.
GRID = """
  SELECT 10 * band.id + sex.id AS subgroup_id, band.low, band.high, sex.concept_id,
         'Persons aged ' || band.low || ' to ' || band.high || ' with gender = ' || sex.label AS name
  FROM (SELECT unnest([{'id': 1, 'concept_id': 8532, 'label': 'Female'},
                       {'id': 2, 'concept_id': 8507, 'label': 'Male'}], recursive := true)) sex,
       (SELECT unnest(range(2, 13)) AS id,
               unnest([0, 6, 18, 35, 55, 65, 75, 85, 0, 5, 12]) AS low,
               unnest([5, 17, 34, 54, 64, 74, 84, 114, 4, 11, 17]) AS high) band"""
# A person is in a band from the year in which they reach its lowest age to the end of the year
# in which they have its highest, as far as they are observed.
MEMBER = """
  SELECT subgroup_id, subject_id, s, e FROM (
    SELECT grid.subgroup_id, person_id AS subject_id,
           greatest(op_start, make_date(year_of_birth + grid.low, 1, 1)) AS s,
           least(op_end, make_date(year_of_birth + grid.high, 12, 31)) AS e
    FROM person JOIN op USING (person_id), grid
    WHERE grid.concept_id = gender_concept_id)
  WHERE s <= e"""
