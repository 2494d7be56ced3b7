"""The ordered step of the sliding-log limit, shared by batch and stream."""

from bisect import bisect_left
from collections import deque


def admit(times: list[int], carry: deque, window: int) -> list[int]:
    """Positions of the accepted times; ``times`` is sorted.

    ``carry`` holds the latest accepted times, at most ``carry.maxlen`` of them,
    and is advanced in place. With a full carry nothing gets in before its
    oldest entry is a window old, so the loop runs once per accepted time.
    """
    taken, i = [], 0
    while i < len(times):
        if len(carry) == carry.maxlen:
            i = bisect_left(times, carry[0] + window, i)
            if i == len(times):
                break
        carry.append(times[i])
        taken.append(i)
        i += 1
    return taken
