"""python -m rankspark COMMAND --data FOLDER [--models FOLDER] ...: see :mod:`rankspark.plans.commands`."""

import sys

from rankspark.plans.commands import main

sys.exit(main())
