import sys

from gaugewise.cli import main

sys.exit(main())
