import sys

from velario.cli import main

sys.exit(main())
