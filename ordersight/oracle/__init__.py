"""The same results as plain SQL over the base tables, written without the operators.

Used only to check the analyses: money is whole cents here and every rounding is integer
arithmetic, so neither side can lean on the other's number handling.
"""

from ordersight.oracle.statements import STATEMENTS
from ordersight.oracle.views import with_views


def oracle_statements() -> dict[str, str]:
    return {key: with_views(body) for key, body in STATEMENTS.items()}
