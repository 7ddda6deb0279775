"""Selection functions of one window, for exact densities by plans.search.exact_counts(): tuple of letters -> place."""

from __future__ import annotations

Window = tuple[int, ...]


def sus(x: Window) -> int:
    """The least suffix, a shorter one coming after its extensions."""
    return min(range(len(x)), key=lambda i: (*x[i:], 1 << 30))


def asus(x: Window) -> int:
    """The suffix with the least first letter, then the largest others; the end counts as largest letter 2 below."""
    return min(range(len(x)), key=lambda i: (x[i], *(-c for c in x[i + 1 :]), 2))


def runs(x: tuple[int, ...]) -> list[tuple[int, int]]:
    """(length, place): each largest value with the smaller ones after it, up to the next."""
    top = [i for i, c in enumerate(x) if c == max(x)]
    return [(j - i, i) for i, j in zip(top, [*top[1:], len(x)], strict=True)]


def longest_run(x: Window) -> int:
    """The last of the longest runs."""
    return max(runs(x))[1]


def longest_run_twice(x: Window) -> int:
    """Of runs, the longest run of their lengths, the last of equal ones."""
    first = runs(x)
    return first[max(runs(tuple(n for n, _ in first)))[1]][1] if len(first) > 1 else first[0][1]


def lyndon_factors(x: Window) -> list[tuple[int, int]]:
    """(begin, end) of the factors that never rise and are each less than their proper suffixes: one begins with each suffix that is less than all before it."""
    begins: list[int] = []
    for i in range(len(x)):
        if not begins or x[i:] < x[begins[-1] :]:
            begins.append(i)
    return list(zip(begins, [*begins[1:], len(x)], strict=True))


def lyndon(x: Window) -> int:
    """The last factor's place, or an earlier one's as long as what follows it begins it."""
    factors = lyndon_factors(x)
    while len(factors) > 1:
        begin, before = factors[-1][0], factors[-2][0]
        if x[before : before + len(x) - begin] != x[begin:]:
            break
        factors.pop()
    return factors[-1][0]


def zeros_then_ones(x: Window) -> int:
    """The last 0 of the longest run of zeros and then ones; of equal ones the first that has the next at an even distance, else the last."""
    found = []
    for i in range(len(x) - 1):
        if (x[i], x[i + 1]) == (0, 1):
            a = i
            while a > 0 and x[a - 1] == 0:
                a -= 1
            b = i + 1
            while b < len(x) and x[b] == 1:
                b += 1
            found.append(((b - a, b - i - 1), i))
    if not found:
        return len(x) - 1
    best = [i for v, i in found if v == max(found)[0]]
    return next((i for i, j in zip(best, best[1:]) if (j - i) % 2 == 0), best[-1])


def both_ways(x: Window) -> int:
    """The place from which letters to the left, least first, and to the right, largest first, compare least in turns; beyond the ends a half counts."""

    def turns(i: int) -> tuple[float, ...]:
        left, right = x[: i + 1][::-1], x[i + 1 :]
        n = max(len(left), len(right))
        return tuple(v for j in range(n) for v in (left[j] if j < len(left) else 0.5, -(right[j] if j < len(right) else 0.5)))

    return min(range(len(x)), key=turns)


def least_rotation(x: Window) -> int:
    return min(range(len(x)), key=lambda i: x[i:] + x[:i])


SELECTIONS = {f.__name__: f for f in (sus, asus, longest_run, longest_run_twice, lyndon, zeros_then_ones, both_ways, least_rotation)}
