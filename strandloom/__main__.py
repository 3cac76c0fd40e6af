import sys

from strandloom.cli import main

sys.exit(main())
