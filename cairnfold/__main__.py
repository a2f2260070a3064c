import sys

from cairnfold.cli import main

sys.exit(main())
