"""python -m credence"""

from .cli import main

main()
