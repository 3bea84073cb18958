import sys

from tabspark.cli import main

sys.exit(main())
