import sys

from chatlens.cli import run

sys.exit(run())
