"""Stop words. Longer lists and other languages are given as parameters or read from a file."""

from __future__ import annotations

#: The short and the full English list.
ENGLISH = """a an and are as at be but by for if in into is it no not of on or such that the their then there
these they this to was with""".split()
FULL_ENGLISH = """a about above after again against all am an and any are aren't as at be because been before being
below between both but by cannot can't could couldn't did didn't do does doesn't doing don't down during each few for
from further had hadn't has hasn't have haven't having he he'd he'll her here here's hers herself he's him himself his
how how's i i'd if i'll i'm in into is isn't it its it's itself i've let's me more most mustn't my myself no nor not of
off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so
some such than that that's the their theirs them themselves then there there's these they they'd they'll they're
they've this those through to too under until up very was wasn't we we'd we'll were we're weren't we've what what's
when when's where where's which while who whom who's why why's with won't would wouldn't you you'd you'll your you're
yours yourself yourselves you've""".split()


def load(path: str) -> list[str]:
    """A list from a file: the first word of each line; a bar begins a remark."""
    with open(path, encoding="utf-8") as f:
        return [w[0] for line in f if (w := line.partition("|")[0].split())]
