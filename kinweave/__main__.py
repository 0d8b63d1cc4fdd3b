import sys

from kinweave.cli import main

sys.exit(main())
