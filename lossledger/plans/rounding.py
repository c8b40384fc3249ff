"""How registered answers are rounded, here and in their SQL."""


def half_shift(digits: int) -> float:
    """Added before rounding, so that exact halves round alike in both engines.

    A thousandth of half a unit of the last digit or less: below what the digits show.
    """
    return 1.7e-7 if digits <= 4 else 1.7 * 10.0 ** -(digits + 3)
