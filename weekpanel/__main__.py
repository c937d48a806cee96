"""``python -m weekpanel <command> ...`` -- see :mod:`weekpanel.cli`."""

import sys

from weekpanel.cli import main

sys.exit(main())
