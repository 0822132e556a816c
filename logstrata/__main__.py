import sys

from logstrata.cli import main

sys.exit(main())
