"""``python -m stainloom``: features of paired images and MAT files."""

import sys

from stainloom.extract import main

if __name__ == "__main__":
    sys.exit(main())
