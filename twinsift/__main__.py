"""python -m twinsift FOLDER [ALGORITHM]: the groups of duplicates in a folder; algorithms are 0 to 5, and others are ignored."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .library import Library
from .schema import ALGORITHMS


def main(arguments: list[str]) -> int:
    if not arguments:
        print(__doc__)
        return 2
    asked = arguments[1] if len(arguments) > 1 else ""
    algorithm = ALGORITHMS[int(asked)] if asked.isdigit() and int(asked) < len(ALGORITHMS) else ALGORITHMS[0]
    library = Library.scan(SparkSession.builder.getOrCreate(), arguments[0], algorithm)
    print(f"{library.discovered} files, {library.cache_hits} known, by {algorithm}")
    for row in library.cards().orderBy("group_id", "pos").toLocalIterator():
        print(f"{row['group_id'] + 1}\t{row['similarity']}\t{row['path']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
