"""python -m gristmill ask|search|urgence|info|eval"""

import sys

from gristmill.plans.commands import main

sys.exit(main())
