"""Entry file for spark-submit: ``spark-submit submit.py <job> ...``."""

from tastegrid.__main__ import main

if __name__ == "__main__":
    main()
