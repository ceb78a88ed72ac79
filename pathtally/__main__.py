import sys

from .cli import main

sys.stdout.write(main())
