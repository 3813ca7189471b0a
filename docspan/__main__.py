import sys

from docspan.cli import main

sys.exit(main())
