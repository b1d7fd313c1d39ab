from seekspark.cli import main

main()
